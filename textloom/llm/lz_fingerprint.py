"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases (each the longest phrase seen before and one more character; a rest at the
end is a phrase seen before). The set of phrases is hashed, and the minimum of each of ``SLOTS`` permuted hashes makes
the signature; two signatures' share of equal minima estimates the Jaccard likeness of their phrase sets, which
stays high where one text helps to compress the other.

Neighbours. Documents are ordered by descending id (any type that sorts), ties by a hash of the text, null ids last.
A range partitioning of ids and hashes alone finds where blocks of that order begin; then each text is shuffled
once, to its block, and a block's first row also to the block before. Rows that repeat both id and text are alike,
so where blocks begin within such a run, its rows are dealt over them at random. A block is about ``BLOCK_BYTES`` of
text, less where that gives fewer than three a core, and more beyond ``MOST_BLOCKS`` of them: blocks are sorted with spills and
read as a stream, and what the driver holds and sends is the first id and hash of each, so ``MOST_BLOCKS`` bounds it.

A null text counts as empty and has the empty signature (all ones); two empty texts have likeness 1, an empty
and another one 0. Whole texts are parsed. Repeated rows are neighbours; with one row, it is its own neighbour.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vocabulary import table_bytes
from .common import arrow_batches, text_or_empty

SLOTS = 64
BLOCK_BYTES = 32 << 20
MOST_BLOCKS = 100_000
#: First rows of up to so many bytes are broadcast to the texts they are looked for among.
BROADCAST_BYTES = 64 << 20
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
EMPTY = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)


def parse(text: str, phrases: set[str], phrase: str = "") -> tuple[list[str], str]:
    """Add the LZ78 phrases of text to ``phrases``; returns the new ones and the unfinished last phrase.

    phrase: an unfinished one to go on with.
    """
    new = []
    for c in text:
        phrase += c
        if phrase not in phrases:
            phrases.add(phrase)
            new.append(phrase)
            phrase = ""
    return new, phrase


def minima(phrases: list[str]) -> np.ndarray:
    """The least permuted hash of each slot; those of a union are the lesser ones of its parts."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
    least = EMPTY.copy()
    for k in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[k : k + 1024, None] * _FACTORS + _SHIFTS).min(0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    return least.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_signature(text: str | None) -> np.ndarray:
    return signature(minima(parse(text or "", set())[0]))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df's doc_id with ``out``: the signature in hex."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_signature(t).tobytes().hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", out])

    return df.select("doc_id", text).mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, {out} string")


def _leads(df: DataFrame, text: str, per_block: int | None) -> list[tuple]:
    """(has an id, id, hash) of the first row of each block, descending."""
    spark = df.sparkSession
    keys = df.select(F.col("doc_id").isNotNull().alias("k"), "doc_id", F.xxhash64(text_or_empty(text)).alias("h"))
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    n = size["n"]
    wanted = n // per_block if per_block else min(n, size["bytes"] // BLOCK_BYTES, MOST_BLOCKS)
    blocks = max(1, wanted, min(n // 100, 3 * spark.sparkContext.defaultParallelism))
    # The row's number splits long runs of one id and text.
    order = [F.col(c).desc() for c in ("k", "doc_id", "h")] + [F.monotonically_increasing_id()]
    # One job: a checkpoint would write a file a block, for each of which an executor starts processes (chmod).
    ranged = keys.repartitionByRange(blocks, *order).withColumn("part", F.spark_partition_id())
    firsts = ranged.groupBy("part").agg(F.max(F.struct("k", "doc_id", "h")).alias("o")).collect()  # a row a block
    return [tuple(r["o"]) for r in sorted(firsts, key=lambda r: r["part"])]


def places(leads: list[tuple], ids: pa.Array, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The block of each row: the last one that begins at it or before; any of those if many begin with its like."""
    ascending = leads[::-1]
    nulls = sum(not k for k, _, _ in leads)  # they come first
    begins = pa.array([i for _, i, _ in ascending[nulls:]], ids.type).to_numpy(zero_copy_only=False)
    first_hash = np.array([h for _, _, h in ascending], np.int64)
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    known = ids.drop_null().to_numpy(zero_copy_only=False)
    # Of the blocks in ascending order, low to high - 1 begin with the row's id; then, of these, those with its hash.
    low, high = np.zeros(len(ids), np.int64), np.full(len(ids), nulls)
    low[valid] = nulls + np.searchsorted(begins, known)
    high[valid] = nulls + np.searchsorted(begins, known, "right")
    group = np.where(low < high, low, -1)
    for at in np.unique(group[group >= 0]):
        own = np.flatnonzero(group == at)
        run = first_hash[at : high[own[0]]]
        low[own], high[own] = at + np.searchsorted(run, hashes[own]), at + np.searchsorted(run, hashes[own], "right")
    last = np.maximum(len(leads) - low - 1, 0)
    first = np.minimum(len(leads) - high, last)
    mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return first + (mixed % (last - first + 1).astype(np.uint64)).astype(np.int64)


def neighbours(df: DataFrame, text: str = "text", per_block: int | None = None) -> DataFrame:
    """Rows dealt to blocks that are consecutive in the order of neighbours, one a partition and sorted, and each
    followed by a guest: the first row of the next block (after the last, of the first).

    per_block: rows of a block, in place of its bytes. Columns: block, doc_id, text, guest. Within a block every row's next document is the next row.
    """
    leads = _leads(df, text, per_block)
    rows = df.select("doc_id", text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    if not leads:
        return rows.select(F.lit(0).alias("block"), "doc_id", "text", F.lit(False).alias("guest"))
    shared = df.sparkSession.sparkContext.broadcast(leads)

    def place(ids: pa.Array, hashes: pa.Array, numbers: pa.Array) -> pa.Array:
        return pa.array(places(shared.value, ids, hashes.to_numpy(), numbers.to_numpy()), pa.int32())

    block = F.arrow_udf(place, "int")(F.col("doc_id"), F.col("h"), F.monotonically_increasing_id())
    own = rows.select(block.alias("block"), "doc_id", "text", F.lit(False).alias("guest"))
    # Each block's first row is also the guest of the block before it; there are as many as blocks.
    spark, kind = df.sparkSession, dict(df.dtypes)["doc_id"]
    firsts = spark.createDataFrame([(o[1], o[2], (k - 1) % len(leads)) for k, o in enumerate(leads)], f"d {kind}, h2 long, block int")
    # One row stands for all of its like, before the copies for several blocks.
    like = firsts.groupBy("d", "h2").agg(F.collect_list("block").alias("blocks"))
    small = table_bytes(like.select("d", "h2", "blocks")) <= BROADCAST_BYTES
    lead = rows.join(F.broadcast(like) if small else like, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h2")))
    one = lead.groupBy("d", "h2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("blocks").alias("blocks"))
    guests = one.select(F.explode("blocks").alias("block"), "doc_id", "text", F.lit(True).alias("guest"))
    dealt = own.unionByName(guests).repartitionById(len(leads), F.col("block"))
    return dealt.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def edited_pairs(df: DataFrame, text: str = "text", per_block: int | None = None) -> DataFrame:
    """For every row: its and its edited text's signature (hex), and their likeness; that of the next document.

    The edited text has its last third replaced by the next document's beginning. The parse of the part that
    both share is done once.
    """
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ids = None  # the row whose next one hasn't come yet
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(1).type
            for block, doc_id, body, guest in zip(*(batch.column(k).to_pylist() for k in range(4))):
                cut = len(body) - len(body) // 3
                phrases: set[str] = set()
                new, open_phrase = parse(body[:cut], phrases)
                kept = minima(new)
                tail, _ = parse(body[cut:], phrases, open_phrase)
                own = signature(np.minimum(kept, minima(tail)))
                if last is not None and last[0] == block:
                    out.append(_pair(last, body, own))
                phrases.difference_update(tail)
                last = None if guest else (block, doc_id, body, cut, phrases, open_phrase, kept, own)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            columns = list(zip(*out)) if out else [[] for _ in names]
            kinds = [ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    kind = dict(df.dtypes)["doc_id"]
    return neighbours(df, text, per_block).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _pair(row: tuple, next_text: str, next_signature: np.ndarray) -> tuple:
    _, doc_id, body, cut, phrases, open_phrase, kept, own = row
    added = next_text[: len(body) - cut]
    edited = signature(np.minimum(kept, minima(parse(added, phrases, open_phrase)[0])))
    digest = hashlib.sha256((body[:cut] + added).encode()).hexdigest()
    return (
        doc_id, len(body), digest, own.tobytes().hex(), edited.tobytes().hex(), likeness(own, edited), likeness(own, next_signature)
    )
