"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint. Words are lower-cased (A-Z) and joined to shingles of ``width`` words, repeats included; a bit of
the 64 is set if it is set in over half of the shingles' XXH64 hashes. A text without words has fingerprint 0.

Links. Fingerprints that differ in at most ``bits`` bits are linked. They are cut into bits // 2 + 1 segments,
so that of two linked ones at least one segment differs by at most one bit; each segment is indexed under all
its variants with one bit as a wildcard, and linked fingerprints meet under an equal variant, where they are
verified. Only distinct fingerprints are indexed: copies collapse before anything is joined.

Within a variant's group links aren't paired off: a group of more than eight that has a link yields a spanning
forest (fewer links than members), which keeps every component and nothing of quadratic size. Groups are swept in
numpy, all groups of a batch of sorted rows together. A group also holds fingerprints that share a segment by
chance (one in two million of all). One of more than ``LARGE`` members is therefore cut again: linked members are
equal in at least one of bits + 1 pieces of their other segments, and only those that are get compared. Keys of more
than ``HOT`` members (known from a sample of 1 in 64, which steers only who meets where) are cut in the same way
before the shuffle, so that no task holds such a group.

A null text counts as empty. Repeated doc_ids link like any rows and share the smallest id. Ids may be of any type
that sorts. A null doc_id has its fingerprint and, if no other id is reachable, a null component. Extra columns are
ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_batches, free_names
from .components import attach, components

LARGE, HOT = 64, 200_000
#: Up to so many rows that don't simply stay are broadcast by ``keep_one``; beyond that, texts are shuffled.
BROADCAST_ROWS = 1_000_000
HASHED = np.uint64(1 << 63)


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    begins = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(begins, stops)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        rows = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(df: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's 64 bits) and text_hash of every row."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "text_hash"])

    kind = dict(df.dtypes)["doc_id"]
    rows = df.select("doc_id", text, F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, text_hash long")


def cuts(bits: int, length: int = 64) -> list[tuple[int, int]]:
    """(first bit, number of bits) of bits // 2 + 1 segments: one of them differs by one bit at most."""
    n = bits // 2 + 1
    edges = [length * i // n for i in range(n + 1)]
    return list(zip(edges, np.diff(edges).tolist()))


def variants(fps: np.ndarray, bits: int) -> np.ndarray:
    """A row of 64 keys for each fingerprint: the wildcard's place, and its segment with that bit cleared."""
    keys = np.empty((len(fps), 64), np.uint64)
    for first, count in cuts(bits):
        segment = (fps >> np.uint64(first)) & np.uint64((1 << count) - 1)
        for place in range(count):
            keys[:, first + place] = np.uint64((first + place) << 32) | (segment & np.uint64(~(1 << place) & 0xFFFFFFFF))
    return keys


def forest(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links (indices) of a spanning forest of the graph that joins fps at most bits apart."""
    left, right = [], []
    unseen = np.arange(len(fps))
    while len(unseen) > 1:
        todo, unseen = [int(unseen[0])], unseen[1:]
        while todo and len(unseen):
            i = todo.pop()
            near = np.bitwise_count(fps[unseen] ^ fps[i]) <= bits
            if near.any():
                found = unseen[near].tolist()
                left += [i] * len(found)
                right += found
                todo += found
                unseen = unseen[~near]
    return left, right


def pieces(fps: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """A row of bits + 1 keys for each member of a group: its pieces of the bits outside the group's segment.

    place: the wildcard's place of the group, which tells the segment. Members at most ``bits`` bits apart share a key.
    """
    keys = np.empty((len(fps), bits + 1), np.uint64)
    for first, count in cuts(bits):
        own = np.flatnonzero((place >= first) & (place < first + count))
        # The other bits, drawn together.
        low = fps[own] & np.uint64((1 << first) - 1)
        high = (fps[own] >> np.uint64(first + count)) if first + count < 64 else np.zeros(len(own), np.uint64)
        rest, left = low | (high << np.uint64(first)), 64 - count
        edges = [left * i // (bits + 1) for i in range(bits + 2)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            keys[own, i] = np.uint64(i << 56) | ((rest >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1))
    return keys


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of sorted keys begin, and their sizes."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return begins, np.diff(np.append(begins, len(keys)))


def _pairs(fps: np.ndarray, begins: np.ndarray, sizes: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within groups, compared shift by shift. A group of more than eight members that has a link gives a
    forest of fewer links than members, as do groups of more than 1,024 members, which aren't compared before."""
    out, linked = [], sizes > 1024
    for shift in range(1, int(sizes[~linked].max(initial=1))):
        groups = np.flatnonzero(~linked & (sizes > shift))
        if not len(groups):
            break
        n = sizes[groups] - shift
        of = np.repeat(groups, n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - begins[groups], n)
        near = np.flatnonzero(np.bitwise_count(fps[at] ^ fps[at + shift]) <= bits)
        linked[of[near][sizes[of[near]] > 8]] = True
        near = at[near[sizes[of[near]] <= 8]]
        out.append((fps[near], fps[near + shift]))
    for g in np.flatnonzero(linked).tolist():
        own = fps[begins[g] : begins[g] + sizes[g]]
        x, y = forest(own, bits)
        out.append((own[np.array(x, np.int64)], own[np.array(y, np.int64)]))
    return out


def sweep(groups: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """groups: sorted keys. Pairs of fps that link within their group, enough to connect all that do."""
    begins, sizes = _starts(groups)
    large = sizes > LARGE
    out = _pairs(fps, begins[~large], sizes[~large], bits)
    for a, m in zip(begins[large].tolist(), sizes[large].tolist()):
        if groups[a] & HASHED:  # cut already
            out += _pairs(fps[a : a + m], np.zeros(1, np.int64), np.array([m]), bits)
            continue
        keys = pieces(fps[a : a + m], np.full(m, int(groups[a]) >> 32), bits)
        order = np.argsort(keys.ravel(), kind="stable")
        members = fps[a + order // (bits + 1)]
        out += _pairs(members, *_starts(keys.ravel()[order]), bits)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])


def _mix(keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A key for each piece of a hot key."""
    mixed = (keys[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (piece * np.uint64(0xBF58476D1CE4E5B9))
    return (mixed ^ (mixed >> np.uint64(29))) | HASHED


def link(distinct: DataFrame, bits: int = 4, hot: int | None = None) -> DataFrame:
    """distinct (fp) to links (a, b) that connect every two fingerprints at most bits apart; bits from 2 to 62."""
    arrow_batches(distinct.sparkSession, 20_000)
    hot = HOT if hot is None else hot
    found = np.empty(0, np.uint64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 1000):
                keys, fps = variants(every[k : k + 1000], bits).ravel(), np.repeat(every[k : k + 1000], 64)
                if len(found):
                    cut = found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys
                    more = _mix(keys[cut], pieces(fps[cut], (keys[cut] >> np.uint64(32)).astype(np.int64), bits)).ravel()
                    keys, fps = np.append(keys[~cut], more), np.append(fps[~cut], np.repeat(fps[cut], bits + 1))
                yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "fp": fps.view(np.int64)})

    def swept(keys: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
        a, b = sweep(np.concatenate(keys).view(np.uint64), np.concatenate(fps).view(np.uint64), bits)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sweep the groups that are complete; the last one waits for the next batch."""
        keys, fps = [], []
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if keys and keys[0][0] == key[-1]:  # all of one group
                keys.append(key), fps.append(fp)
                continue
            done = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            keys.append(key[:done]), fps.append(fp[:done])
            yield swept(keys, fps)
            keys, fps = [key[done:]], [fp[done:]]
        if keys:
            yield swept(keys, fps)

    indexed = distinct.select("fp")
    sample = indexed.filter(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0).mapInArrow(index, "key long, fp long")
    rows = sample.groupBy("key").count().filter(F.col("count") * 64 >= hot).select("key").collect()
    found = np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    dealt = indexed.mapInArrow(index, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(df: DataFrame, text: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, text_hash, component_id (the smallest doc_id reachable, itself included) and component (the
    least fingerprint of the component, which also tells apart components without an id) of every row."""
    docs = cut_lineage(fingerprints(df, text, width))
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(distinct, bits))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = attach(joined.select("fp", "root"), smallest, "root", "fp").select("fp", "component_id", F.col("root").alias("component"))
    return attach(docs, classes, "fp", "doc_id")


def keep_one(df: DataFrame, text: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """df with one row of each component: that of the smallest doc_id (nulls last; ties by the text's hash)."""
    rows = cut_lineage(near_duplicates(df, text, width, bits))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    same = rows.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    told = attach(same, best, "component", "text_hash").withColumn("stays", F.col("best").eqNullSafe(order))
    # Most rows stay as they are; the others are those that go, and repeated ones of which one stays.
    others = cut_lineage(told.filter(~F.col("stays") | (F.col("n") > 1)).select("doc_id", "text_hash", "stays"))
    few, repeated = others.count() <= BROADCAST_ROWS, not others.filter("stays").isEmpty()
    d, h, stays, own = free_names(df, "_id", "_hash", "_stays", "_own")
    others = others.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("stays").alias(stays))
    found = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h))
    marked = df.withColumn(own, F.xxhash64(text)).join(F.broadcast(others) if few else others, found, "left").drop(d, h)
    kept = marked.filter(F.col(stays).isNull())
    if repeated:
        kept = kept.unionByName(marked.filter(F.col(stays)).dropDuplicates(["doc_id", own]))
    return kept.drop(stays, own)
