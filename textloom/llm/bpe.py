"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each leaf of the tree is a byte position; the live neighbour pair that starts there has a rank (none: a large
number). Every node holds the leftmost position of its least rank, so the root names the next merge. A merge
changes the ranks of at most three positions (the merged token, its left neighbour, the token it swallowed) and
each change climbs the tree once: a piece of n bytes costs O(n log n).

Texts are cut at single spaces into chunks that the split pattern treats independently; chunks and their pieces
are encoded once while they stay in a worker's bounded cache, and a batch's new short pieces climb their trees
together in numpy (one row a piece). Texts with runs of white space around a space are split as a whole.

A null text counts as empty: no ids, no bytes. Texts are never shortened. Repeated rows are encoded one by
one; extra columns pass through, those named like an output are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_batches

#: Pieces of more bytes are encoded one by one in Python lists.
SHORT = 64
#: Chunks and pieces in the younger of two generations that a worker remembers. When it is full it becomes the
#: older one, whose entries go unless they are met again before the next turn.
CACHE_CHUNKS = 200_000
#: Texts of a batch (of 8 MB at most): the more, the more chunks and merges they share.
BATCH_ROWS = 2048
NONE = 1 << 30


def _key(piece: str) -> str:
    """Chunks are kept under what follows their space; those without one, or with more, after a space."""
    return piece[1:] if piece[:1] == " " and " " not in piece[1:] else " " + piece


class ByteBpe:
    """Ranks of a byte-level BPE; ``encode`` gives ids of texts, ``decode`` the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern)
        self.keeps_words = r"| ?\p{L}+|" in f"|{pattern}|"
        self.crowded = regex.compile(r"\s \s|\s \Z")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = len(self.bytes_of)
        pairs = [
            (ranks[t[:i]] * self.size + ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [NONE], np.int64)
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    # one long piece -------------------------------------------------------------------------------------

    def merge_long(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n - 1))  # the live token before the one that starts here
        width = 1 << max(1, (n - 1).bit_length())
        rank = [ranks.get(piece[i : i + 2], NONE) if i + 1 < n else NONE for i in range(width)]
        tree = [0] * width + list(range(width))
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if rank[a] <= rank[b] else b

        def update(i: int, r: int) -> None:
            rank[i] = r
            node = (i + width) >> 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if rank[a] <= rank[b] else b
                node >>= 1

        while rank[i := tree[1]] < NONE:
            j = ends[i]
            end = ends[i] = ends[j]
            if end < n:
                before[end] = i
            update(j, NONE)
            update(i, ranks.get(piece[i : ends[end]], NONE) if end < n else NONE)
            if (left := before[i]) >= 0:
                update(left, ranks.get(piece[left:end], NONE))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    # many short pieces ----------------------------------------------------------------------------------

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_short(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """pieces of 2 to width bytes, width a power of two: a row of each array is a piece."""
        m = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        ids = self.byte_id[raw]
        column = np.arange(width)
        ends = np.tile(column + 1, (m, 1))
        before = np.tile(column - 1, (m, 1))
        rank = np.full((m, width), NONE, np.int64)
        rank[:, :-1] = np.where(column[1:] < lengths[:, None], self._pair_rank(ids[:, :-1], ids[:, 1:]), NONE)
        tree = np.zeros((m, 2 * width), np.int64)
        tree[:, width:] = column
        for first in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
            a, b = tree[:, 2 * first : 4 * first : 2], tree[:, 2 * first + 1 : 4 * first : 2]
            tree[:, first : 2 * first] = np.where(np.take_along_axis(rank, a, 1) <= np.take_along_axis(rank, b, 1), a, b)
        live = column < lengths[:, None]
        # Flat views: a cell of row r is at r * width + its column.
        flat_ids, flat_ends, flat_before, flat_rank = ids.ravel(), ends.ravel(), before.ravel(), rank.ravel()
        flat_tree, flat_live = tree.ravel(), live.ravel()

        def update(row: np.ndarray, at: np.ndarray, ranks: np.ndarray | int) -> None:
            flat_rank[row + at] = ranks
            node, top = (at + width) >> 1, 2 * row
            for _ in range(width.bit_length() - 1):
                below = top + 2 * node
                a, b = flat_tree[below], flat_tree[below + 1]
                flat_tree[top + node] = np.where(flat_rank[row + a] <= flat_rank[row + b], a, b)
                node >>= 1

        row, stop = np.arange(m) * width, lengths
        while True:
            i = flat_tree[2 * row + 1]
            found = flat_rank[row + i]
            going = found < NONE
            row, stop, i, found = row[going], stop[going], i[going], found[going]
            if not len(row):
                break
            j = flat_ends[row + i]
            end = flat_ends[row + j]
            flat_ids[row + i] = found
            flat_ends[row + i] = end
            flat_live[row + j] = False
            inner = end < stop
            begun, at, then = row[inner], i[inner], end[inner]
            flat_before[begun + then] = at
            update(row, j, NONE)
            after = np.full(len(row), NONE)
            after[inner] = self._pair_rank(found[inner], flat_ids[begun + then])
            update(row, i, after)
            left = flat_before[row + i]
            has = left >= 0
            begun, left = row[has], left[has]
            update(begun, left, self._pair_rank(flat_ids[begun + left], found[has]))
        got = flat_ids[flat_live].tolist()
        upto = np.cumsum(live.sum(1)).tolist()
        return [got[a:b] for a, b in zip([0, *upto], upto)]

    def merge(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct piece."""
        found: dict[bytes, list[int]] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in set(pieces):
            if piece in self.ranks:
                found[piece] = [self.ranks[piece]]
            elif len(piece) > SHORT:
                found[piece] = self.merge_long(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for width, same in by_width.items():
            for k in range(0, len(same), 4096):
                found.update(zip(same[k : k + 4096], self.merge_short(same[k : k + 4096], width)))
        return found

    # texts ----------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = []
        for text in texts:
            if self.crowded.search(text):
                parts.append([" " + text])
            else:
                own = text.split(" ")
                own[0] = " " + own[0]
                parts.append(own)
        new = self._unknown(set(chain.from_iterable(parts)))
        # A space and ASCII letters are one piece of the pattern only if it says so; then they needn't be split.
        plain = {k for k in new if k.isalpha() and k.isascii()} if self.keeps_words else set()
        cut = {k: (" " + k,) for k in plain}
        cut.update((k, self.split.findall(k[1:] if k[:1] == " " else " " + k)) for k in new - plain)
        pieces = {p: _key(p) for p in set(chain.from_iterable(cut.values()))}
        known = self.chunks
        unknown = self._unknown(set(pieces.values()), make_room=False)
        raw = {p: p.encode() for p, k in pieces.items() if k in unknown}
        merged = self.merge(raw.values())
        own_ids = {p: tuple(merged[b]) for p, b in raw.items()}
        known.update((pieces[p], ids) for p, ids in own_ids.items() if len(p) <= SHORT)
        own_ids.update((p, known[k]) for p, k in pieces.items() if p not in own_ids)
        large: dict[str, tuple[int, ...]] = {}
        for k, own in cut.items():
            ids = own_ids[own[0]] if len(own) == 1 else tuple(chain.from_iterable(map(own_ids.__getitem__, own)))
            (known if len(k) <= SHORT else large)[k] = ids
        find = (lambda k: large[k] if k in large else known[k]) if large else known.__getitem__
        return [np.fromiter(chain.from_iterable(map(find, own)), np.int32) for own in parts]

    def _unknown(self, wanted: set[str], make_room: bool = True) -> set[str]:
        """What of wanted no generation knows; what the older one knows moves to the younger."""
        new = wanted - self.chunks.keys()
        if make_room and len(self.chunks) + len(new) > CACHE_CHUNKS:
            self.older, self.chunks = self.chunks, {}
            new = set(wanted)
        moved = new & self.older.keys()
        self.chunks.update((c, self.older[c]) for c in moved)
        return new - moved

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file (base64 token, blank, rank a line); one for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, without: str = "") -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in (name, without)]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], names=[*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType, without: str = "") -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in (name, without)] + [T.StructField(name, kind)])


def _coded(bpe: ByteBpe, batch: pa.RecordBatch, text: str, ids: str, without: str) -> pa.RecordBatch:
    found = bpe.encode([x or "" for x in batch.column(text).to_pylist()])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    return _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), without)


def _decoded(bpe: ByteBpe, batch: pa.RecordBatch, ids: str, out: str) -> pa.RecordBatch:
    whole = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in batch.column(ids)]
    return _with(batch, out, pa.array(whole, pa.binary()))


@contextmanager
def _no_cycle_search() -> Iterator[None]:
    """The caches hold very many small objects and no cycles; searching these for cycles again and again is a waste."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """df with the array ``ids``. vocabulary: the rank file's path, the same on every executor."""
    arrow_batches(df.sparkSession, BATCH_ROWS)
    without = "" if keep_text else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        with _no_cycle_search():
            for batch in batches:
                yield _coded(bpe, batch, text, ids, without)

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType()), without))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the bytes of the array of ids (null: none)."""
    arrow_batches(df.sparkSession, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            yield _decoded(bpe, batch, ids, out)

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))


def round_trip(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep_text: bool = False
) -> DataFrame:
    """df with ``ids`` and with ``out``, the bytes decoded from these ids, in one pass: ids travel once."""
    arrow_batches(df.sparkSession, BATCH_ROWS)
    without = "" if keep_text else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        with _no_cycle_search():
            for batch in batches:
                yield _decoded(bpe, _coded(bpe, batch, text, ids, without), ids, out)

    coded = _schema(df, ids, T.ArrayType(T.IntegerType()), without)
    return df.mapInArrow(run, T.StructType([*(f for f in coded if f.name != out), T.StructField(out, T.BinaryType())]))
