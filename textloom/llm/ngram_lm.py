"""Language-model scoring with an Elias-Fano n-gram trie.

Levels. Level 1 is the sorted 64-bit hashes of the distinct tokens (a token's id is its rank) with its counts as
an Elias-Fano sequence of running sums. Level k holds, for every context (a node of level k - 1), the ids of its
successors: the pointers to the contexts' ranges and the successors (relative to the end of the range before) are
Elias-Fano sequences; each n-gram has its smoothed log10 probability in 16 bits. A lookup reads its context's
range and searches the successor there.

Smoothing. p1(w) = (c(w) + 1) / (N + V + 1);  pk(w | ctx) = (c(ctx w) + mass * pk-1(w | shorter ctx)) / (c(ctx) + mass),
a Dirichlet prior, which sums to one over the vocabulary and an unknown token. An unseen n-gram backs off with
mass / (c(ctx) + mass). A text's end is a token, and the context of the next text's first one.

Spread. Words are dealt to shards by hash range. The n-grams of a level are dealt by ranges of contexts that hold
about ``tokens_per_shard`` occurrences each, found from marks that the level below leaves at every eighth of that;
a context that crosses marks, however frequent, is spread over all shards that it crosses by its words' ids. Tasks
emit their distinct n-grams with counts as sorted runs, so counts are combined before the shuffle. An n-gram
travels with its word's probability after the shorter context, which the counting task has looked up already, so
building needs no other shard. A shard becomes one file in the shared folder. All counts are kept, however rare.

Memory. Counting and scoring tasks map the files (about 5 bytes an n-gram in all; the pages they touch are
shared by a machine's workers and may be dropped at any time). Where the shared folder is no file system that can
be mapped, a worker reads them into memory instead, at most ``OPEN_FILES`` of them. The driver holds three numbers
and eight marks a shard, which it writes to the folder as an index that tasks map too.

Tokens are told apart by their XXH3 hash of 64 bits. Among V distinct ones two collide with odds of about
V * V / 3.7e19 (one in 37,000 for thirty million words); they would then count as one word.

A null or empty text is its end token alone. Null ids are trained on. Repeated rows count as often as they
occur. Extra columns are ignored. Without any training text every token is unknown. A text is held whole by its
task, with about 100 bytes a word.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .common import arrow_batches, pooled, split_words
from .elias_fano import EliasFano, U

STEPS = 4096.0  # quantisation: 1/4096 of a decimal digit
POOL = 10 << 20  # bytes of text that a task looks up together
OPEN_FILES = 8192
#: The end of a text: no word has a space.
END = U(xxhash.xxh3_64_intdigest(b" end"))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct token hashes, ascending, the place of each token among them, and each text's number of
    tokens; a text's end is its last token."""
    words, codes, lengths = split_words(column)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))
    distinct, place = np.unique(np.append(hashes, END), return_inverse=True)
    out = np.full(len(codes) + len(lengths), place[-1])
    text_of_word = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(codes)) + text_of_word] = place[codes]
    return distinct, out, lengths + 1


# files ----------------------------------------------------------------------------------------------------


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to a file of the folder (a URI): 8-byte aligned, with a directory at the end.

    The file gets its name when it is complete; attempts of one task write the same bytes.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/{uuid.uuid4().hex}.part"
    directory, at = {}, 0
    with store.open_output_stream(own, compression=None) as out:
        for key, array in arrays.items():
            body = np.ascontiguousarray(array).tobytes()
            directory[key] = (at, array.dtype.str, len(array))
            out.write(body + b"\0" * (-len(body) % 8))
            at += len(body) + -len(body) % 8
        tail = json.dumps(directory).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    store.move(own, f"{root}/{name}")


@lru_cache(maxsize=OPEN_FILES)
def _open(uri: str) -> dict[str, np.ndarray]:
    """A file's arrays: mapped, or read where the store can't be mapped."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        whole = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_stream(path) as source:
            whole = np.frombuffer(source.read(), np.uint8)
    size = int.from_bytes(whole[-8:].tobytes(), "little")
    directory = json.loads(whole[-8 - size : -8].tobytes())
    return {k: np.asarray(whole[at : at + n * np.dtype(d).itemsize]).view(d) for k, (at, d, n) in directory.items()}


def _packed(name: str, sequence: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in sequence.arrays.items()}


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k.partition(".")[2]: v for k, v in arrays.items() if k.startswith(f"{name}.")})


# the model ------------------------------------------------------------------------------------------------


class Shard:
    """One file of a level. Its nodes are numbered from 0, its contexts by ``first_context`` and up."""

    def __init__(self, uri: str):
        arrays = _open(uri)
        self.sums = _sequence(arrays, "sums") if "sums.meta" in arrays else None
        if "keys.meta" in arrays:
            self.keys = _sequence(arrays, "keys")
        else:
            self.pointers, self.next = _sequence(arrays, "pointers"), _sequence(arrays, "next")
            self.probs, self.first_context = arrays["probs"], int(arrays["first_context"][0])

    def counts(self, local: np.ndarray) -> np.ndarray:
        before, after = self.sums.pair(local)
        return (after - before).astype(np.int64)

    def find_key(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        at = self.keys.successor(key, np.zeros(len(key), np.int64), np.full(len(key), self.keys.n))
        there = at < self.keys.n
        there[there] = self.keys.access(at[there]) == key[there]
        return np.where(there, at, -1)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Local index of each n-gram, or -1: successor search within the context's range."""
        out = np.full(len(context), -1)
        rank = context - self.first_context
        rows = np.flatnonzero((rank >= 0) & (rank < self.pointers.n - 1))
        begin, stop = (x.astype(np.int64) for x in self.pointers.pair(rank[rows]))
        some = begin < stop
        rows, begin, stop = rows[some], begin[some], stop[some]
        # Words are relative to one more than the value before the range; most ranges end with their first value.
        before, value = self.next.pair(np.maximum(begin - 1, 0))
        before, value = np.where(begin > 0, before + U(1), U(0)), np.where(begin > 0, value, before)
        target = before + word[rows].astype(U)
        here = value == target
        out[rows[here]] = begin[here]
        more = np.flatnonzero((value < target) & (stop - begin > 1))
        at = self.next.successor(target[more], begin[more] + 1, stop[more])
        there = at < stop[more]
        there[there] = self.next.access(at[there]) == target[more][there]
        out[rows[more[there]]] = at[there]
        return out


@lru_cache(maxsize=OPEN_FILES)
def _shard(uri: str) -> Shard:
    return Shard(uri)


@lru_cache(maxsize=16)
def _index(uri: str) -> dict[str, np.ndarray]:
    return _open(uri)


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its rows) of rows dealt to shards."""
    order = np.argsort(shards.astype(np.uint16) if len(shards) and shards.max() < 1 << 16 else shards, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(shards[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(shards[order[a]]), order[a:b]


def _distinct(high: np.ndarray, low: np.ndarray, highs: int, lows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pairs in ascending order: a place of each; the pair of every place; the number of each.

    Pairs and places are sorted as one number where they fit into 64 bits, which is several times faster.
    """
    shift, place = U(max(1, lows.bit_length())), U(max(1, len(high).bit_length()))
    key = (high.astype(U) << shift) | low.astype(U)
    if highs.bit_length() + int(shift + place) <= 64:
        key = np.sort((key << place) | np.arange(len(key), dtype=U))
        order, key = (key & ((U(1) << place) - U(1))).astype(np.int64), key >> place
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    codes = np.empty(len(key), np.int64)
    codes[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], codes, np.diff(np.append(first, len(key)))


def _deal(bounds: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The shard of each n-gram: its context's, or by the word's id one of those that the context crosses."""
    left, right = (np.searchsorted(bounds, context, side=s) for s in ("left", "right"))
    return left + word % (right - left + 1)


class Grams(NamedTuple):
    """The distinct n-grams of a batch: node (or -1) and log10 probability of each, and each token's place among them.

    Place 0 is that of tokens that have no n-gram of this length.
    """

    nodes: np.ndarray
    probs: np.ndarray
    codes: np.ndarray


class Trie(NamedTuple):
    """What scoring needs: the folder of the levels' files, the number of levels, and the totals.

    A level's index has ``first`` (the global number of each shard's first node, and the number of nodes), and
    ``bounds``: the contexts at which a level's shards meet.
    """

    folder: str
    order: int
    tokens: int
    words: int
    mass: float

    def index(self, level: int) -> dict[str, np.ndarray]:
        return _index(f"{self.folder}/{level}.index")

    def shard(self, level: int, k: int) -> Shard:
        return _shard(f"{self.folder}/{level}-{k}.level")

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (or -1) and counts of sorted hashes."""
        first = self.index(1)["first"]
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        width = _width(len(first) - 1)
        edges = np.append(np.searchsorted(hashes, np.arange(len(first) - 1, dtype=U) << U(min(width, 63))), len(hashes))
        for k in range(len(first) - 1):
            a, b = int(edges[k]), int(edges[k + 1])
            if a == b or first[k] == first[k + 1]:
                continue
            shard = self.shard(1, k)
            local = shard.find_key(hashes[a:b] & U((1 << width) - 1))
            known = np.flatnonzero(local >= 0)
            ids[a + known] = local[known] + first[k]
            counts[a + known] = shard.counts(local[known])
        return ids, counts

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Global node (or -1) and log10 probability (0 if absent) of each n-gram."""
        first = self.index(level)["first"]
        nodes, probs = np.full(len(context), -1), np.zeros(len(context))
        for k, rows in _by_shard(_deal(self.index(level)["bounds"], context, word)):
            if first[k] == first[k + 1]:
                continue
            shard = self.shard(level, k)
            local = shard.find(context[rows], word[rows])
            there = local >= 0
            rows, local = rows[there], local[there]
            nodes[rows] = local + first[k]
            probs[rows] = shard.probs[local] / -STEPS
        return nodes, probs

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The counts of global nodes; 0 for -1."""
        first = self.index(level)["first"]
        out = np.zeros(len(nodes), np.int64)
        known = np.flatnonzero(nodes >= 0)
        for k, rows in _by_shard(np.searchsorted(first, nodes[known], side="right") - 1):
            rows = known[rows]
            out[rows] = self.shard(level, k).counts(nodes[rows] - first[k])
        return out

    def word_probs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words + 1))

    def read(self, column: pa.Array) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The words of a batch, each distinct one's count, and each text's number of tokens."""
        distinct, codes, lengths = tokens(column)
        ids, counts = self.find_words(distinct)
        return Grams(np.append(-1, ids), np.append(0.0, self.word_probs(counts)), codes + 1), np.append(0, counts), lengths

    def extend(self, words: Grams, shorter: Grams, lengths: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
        """Of the distinct n-grams of a level: context, word, lower log10 probability, number; and the tokens' places."""
        context = np.roll(shorter.codes, 1)
        # Every text ends with the same token, which is the context of the next one's first.
        context[np.cumsum(lengths) - lengths] = words.codes[-1] if level == 2 else 0
        at, codes, number = _distinct(context, words.codes, len(shorter.nodes), len(words.nodes))
        if not context[at[0]]:  # tokens without such a context share place 0, whatever their word
            none = int(np.searchsorted(context[at], 1))
            codes = np.maximum(codes - (none - 1), 0)
            at, number = at[none:], number[none:]
        else:
            codes += 1
        return shorter.nodes[context[at]], words.nodes[words.codes[at]], shorter.probs[shorter.codes[at]], number, codes

    def step(self, words: Grams, shorter: Grams, lengths: np.ndarray, level: int) -> Grams:
        """The n-grams of a level in a batch, from those one word shorter."""
        context, word, probs, _, codes = self.extend(words, shorter, lengths, level)
        nodes = np.full(len(context), -1)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        nodes[known], found = self.find(level, context[known], word[known])
        there = nodes[known] >= 0
        probs[known[there]] = found[there]
        missing = np.flatnonzero(nodes < 0)
        probs[missing] += np.log10(self.mass / (self.counts(level - 1, context[missing]) + self.mass))
        return Grams(np.append(-1, nodes), np.append(0.0, probs), codes)


def _width(shards: int) -> int:
    """The bits of a word's hash below those that choose one of 2 ** n shards."""
    return 64 - (shards - 1).bit_length()


# building -------------------------------------------------------------------------------------------------

RUN = "shard long, keys binary, counts binary, probs binary"


def _run(shard: int, keys: np.ndarray, counts: np.ndarray, probs: np.ndarray) -> pa.RecordBatch:
    """A sorted run as one row: the keys' differences, byte by byte and without the leading zeros, which compress."""
    steps = np.diff(keys, prepend=U(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    parts = [np.ascontiguousarray(planes.T).tobytes(), counts.astype("<u4").tobytes(), probs.astype("<u2").tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=["shard", "keys", "counts", "probs"]
    )


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a shard's runs, ascending, with their counts summed, and the quantised probabilities."""
    keys, counts, probs = [], [], []
    for k, c, p in zip(rows["keys"], rows["counts"], rows["probs"]):
        number = np.frombuffer(c.as_buffer(), "<u4")
        planes = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, len(number))
        steps = np.zeros((len(number), 8), np.uint8)
        steps[:, : len(planes)] = planes.T
        keys.append(np.cumsum(steps.view("<u8").ravel(), dtype=U))
        counts.append(number)
        probs.append(np.frombuffer(p.as_buffer(), "<u2"))
    key, count, prob = np.concatenate(keys), np.concatenate(counts), np.concatenate(probs)
    del keys, counts, probs
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count[order], first, dtype=np.int64), prob[order[first]]


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(log10 * -STEPS), 65535).astype(np.uint16)


BUILT = "shard long, nodes long, tokens long, marks array<long>"


def _built(shard: int, counts: np.ndarray, every: int) -> pa.Table:
    """The shard's row for the driver; marks: the nodes that hold occurrence 0, every, 2 * every and so on."""
    upto = np.cumsum(counts)
    marks = np.searchsorted(upto, np.arange(0, int(upto[-1]), every), side="right")
    return pa.table(
        {
            "shard": pa.array([shard], pa.int64()),
            "nodes": pa.array([len(counts)], pa.int64()),
            "tokens": pa.array([int(upto[-1])], pa.int64()),
            "marks": pa.array([marks.tolist()], pa.list_(pa.int64())),
        }
    )


def _sums(counts: np.ndarray) -> dict[str, np.ndarray]:
    sums = np.concatenate([[0], np.cumsum(counts)])
    return _packed("sums", EliasFano.build(sums, int(sums[-1]) + 1))


def _finish_level(built: DataFrame, folder: str, level: int, shards: int, bounds: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Write a level's index; its nodes and tokens, and the bounds of the next level's shards."""
    rows = {r["shard"]: r for r in cut_lineage(built).collect()}
    first = np.concatenate([[0], np.cumsum([rows[k]["nodes"] if k in rows else 0 for k in range(shards)])]).astype(np.int64)
    _store(folder, f"{level}.index", {"first": first, "bounds": bounds.astype(np.int64)})
    marks = [first[k] + np.array(rows[k]["marks"], np.int64) for k in sorted(rows)]
    after = np.concatenate(marks)[8::8] if marks else np.zeros(0, np.int64)
    return int(first[-1]), sum(r["tokens"] for r in rows.values()), after


def train(texts: DataFrame, order: int = 3, mass: float = 1000.0, tokens_per_shard: int = 2_000_000, docs_per_word_shard: int = 40_000) -> Trie:
    """texts: one string column. The trie's files stay in the shared folder.

    mass: the weight of the shorter context's distribution, in counts (on held-out text 1,000 did better than
    0.5 to 500). tokens_per_shard: about 60 bytes each is what a building task holds.
    """
    arrow_batches(texts.sparkSession, 1024)
    folder = shared_folder(texts.sparkSession, "trie")
    shards = 1 << max(0, (texts.count() // docs_per_word_shard).bit_length())
    width, every = _width(shards), max(1, tokens_per_shard // 8)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches, POOL):
            keys, codes, _ = tokens(batch.column(0))
            counts = np.bincount(codes, minlength=len(keys))
            keys, counts = keys[counts > 0], counts[counts > 0]
            dealt = keys >> U(width) if shards > 1 else np.zeros(len(keys), U)
            for k, rows in _by_shard(dealt.astype(np.int64)):
                yield _run(k, keys[rows], counts[rows], np.zeros(len(rows)))

    def build_words(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        keys, counts, _ = _merged(rows)
        _store(folder, f"1-{shard}.level", _packed("keys", EliasFano.build(keys & U((1 << width) - 1), 1 << width)) | _sums(counts))
        return _built(shard, counts, every)

    built = texts.mapInArrow(count_words, RUN).groupBy("shard").applyInArrow(build_words, BUILT)
    words, total, bounds = _finish_level(built, folder, 1, shards, np.zeros(0))
    trie = Trie(folder, 1, total, words, mass)
    for level in range(2, order + 1):
        bounds = _add_level(texts, trie, level, bounds, every, last=level == order)
        trie = trie._replace(order=level)
    return trie


def _add_level(texts: DataFrame, trie: Trie, level: int, bounds: np.ndarray, every: int, last: bool) -> np.ndarray:
    """Count and build a level; bounds: the contexts where its shards meet."""
    shards, span = len(bounds) + 1, max(trie.words, 1)
    # A shard's contexts lie between two bounds, both included.
    lowest, highest = np.append(0, bounds).astype(np.int64), np.append(bounds, trie.index(level - 1)["first"][-1]).astype(np.int64)
    if shards and (int((highest - lowest).max()) + 1) * span >= 1 << 63:
        raise ValueError("tokens_per_shard is too large for this vocabulary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches, POOL):
            words, _, lengths = trie.read(batch.column(0))
            grams = words
            for k in range(2, level):
                grams = trie.step(words, grams, lengths, k)
            context, word, lower, number, _ = trie.extend(words, grams, lengths, level)
            for k, rows in _by_shard(_deal(bounds, context, word)):
                keys = (context[rows] - lowest[k]).astype(U) * U(span) + word[rows].astype(U)
                order = np.argsort(keys, kind="stable")
                rows = rows[order]
                yield _run(k, keys[order], number[rows], _quantised(lower[rows]))

    def build(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        keys, counts, lower = _merged(rows)
        context, word = (keys // U(span)).astype(np.int64), (keys % U(span)).astype(np.int64)
        del keys
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sizes = np.diff(np.append(first, len(context)))
        begin = int(context[0])
        ranges = np.zeros(int(context[-1]) - begin + 1, np.int64)
        ranges[context[first] - begin] = sizes
        # Each range starts one above the last value of the range before.
        base = np.concatenate([[0], np.cumsum(word[first + sizes - 1] + 1)[:-1]])
        values = word + np.repeat(base, sizes)
        total = np.repeat(trie.counts(level - 1, context[first] + lowest[shard]), sizes)
        probs = np.log10((counts + trie.mass * 10 ** (lower / -STEPS)) / (total + trie.mass))
        arrays = (
            {"first_context": np.array([begin + lowest[shard]], np.int64), "probs": _quantised(probs)}
            | _packed("pointers", EliasFano.build(np.concatenate([[0], np.cumsum(ranges)]), len(context) + 1))
            | _packed("next", EliasFano.build(values, int(values[-1]) + 1))
            | ({} if last else _sums(counts))
        )
        _store(trie.folder, f"{level}-{shard}.level", arrays)
        return _built(shard, counts, every)

    built = texts.mapInArrow(count, RUN).groupBy("shard").applyInArrow(build, BUILT)
    return _finish_level(built, trie.folder, level, shards, bounds)[2]


# scoring --------------------------------------------------------------------------------------------------


def score(df: DataFrame, trie: Trie, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (level 1 only) and score (log10 probability of the text)."""
    arrow_batches(df.sparkSession, 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pooled(batches, POOL):
            words, counts, lengths = trie.read(batch.column(1))
            begins, grams = np.cumsum(lengths) - lengths, words
            final = words.probs[words.codes]
            for level in range(2, trie.order + 1):
                grams = trie.step(words, grams, lengths, level)
                final = np.where(grams.codes > 0, grams.probs[grams.codes], final)
            known = np.add.reduceat((counts > 0).astype(np.int64)[words.codes], begins)
            base = np.add.reduceat(words.probs[words.codes], begins)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (lengths.astype(np.int64), known, base, np.add.reduceat(final, begins)))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def remainder(folds: int = 7, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))
