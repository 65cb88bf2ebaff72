"""Word vectors as files in the shared folder, which tasks map into memory: for matrices too large to broadcast.

A word is known by its XXH64 (seed 42, as Spark's xxhash64), so among V words two share one with odds of about
V * V / 3.7e19. Its high bits choose the shard; a shard is one file with its sorted hashes and their vectors, in the
element type that the table has (float or double), and is written by one task, about ``SHARD_BYTES`` each. Of rows with
the same word the least vector stays; null words and null vectors go.

A batch of sentences looks up each of its distinct words once. Pages of a mapped file are shared by the tasks of a
machine and dropped by the system when memory is short. Where the folder can't be mapped, whole shards are read and at most
``HELD_BYTES`` of them are kept by a worker.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import shared_folder

SHARD_BYTES = 32 << 20
HELD_BYTES = 256 << 20


class VectorStore(NamedTuple):
    folder: str
    shards: int
    dim: int
    kind: str  # numpy's name of the element type
    words: int

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word in a table of vectors, -1 for unknown words, and the table."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode(), 42) for w in words), np.uint64, len(words))
        places, parts, n = np.full(len(words), -1), [], 0
        if self.shards:
            shard = shard_of(hashes, self.shards)
            for k in np.unique(shard):
                own = np.flatnonzero(shard == k)
                keys, table = _open(self.folder, int(k))
                at = np.minimum(np.searchsorted(keys, hashes[own]), max(0, len(keys) - 1))
                hit = keys[at] == hashes[own] if len(keys) else np.zeros(len(own), bool)
                places[own[hit]] = n + np.arange(hit.sum())
                parts.append(table[at[hit]].astype(np.float64))
                n += len(parts[-1])
        return places, np.concatenate(parts) if n else np.zeros((0, max(1, self.dim)))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hashes' high 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


#: Shards that a worker has open, by file; mapped ones weigh nothing.
_held: OrderedDict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _weight(arrays: tuple[np.ndarray, np.ndarray]) -> int:
    return 0 if isinstance(arrays[1], np.memmap) else sum(a.nbytes for a in arrays)


def _open(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    if (folder, shard) not in _held:
        store, root = fs.FileSystem.from_uri(folder)
        names = (f"{root}/{shard}.keys.npy", f"{root}/{shard}.table.npy")
        if isinstance(store, fs.LocalFileSystem):
            found = tuple(np.load(n, mmap_mode="r") for n in names)
        else:
            found = tuple(np.load(io.BytesIO(store.open_input_stream(n).read())) for n in names)
        _held[folder, shard] = found
        while sum(map(_weight, _held.values())) > HELD_BYTES and len(_held) > 1:
            _held.popitem(last=False)
    _held.move_to_end((folder, shard))
    return _held[folder, shard]


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """The file gets its name when it is complete; attempts of one task write the same bytes."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    body = io.BytesIO()
    np.save(body, array)
    own = f"{root}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(own, compression=None) as out:
        out.write(body.getbuffer())
    store.move(own, f"{root}/{name}")


def store_vectors(vectors: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> VectorStore:
    """Write (word, vector array<float> or array<double>) as a store; nothing but its counts comes to the driver."""
    folder = folder or shared_folder(vectors.sparkSession, "vectors")
    kind = "f4" if vectors.schema["vector"].dataType == T.ArrayType(T.FloatType()) else "f8"
    rows = vectors.select("word", F.col("vector").cast("array<float>" if kind == "f4" else "array<double>").alias("vector"))
    rows = rows.filter("word IS NOT NULL AND vector IS NOT NULL").withColumn("hash", F.xxhash64("word"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).first()
    n, dim = size["n"], size["dim"]
    shards = -(-n * dim * np.dtype(kind).itemsize // shard_bytes)
    if not shards:
        return VectorStore(folder, 0, dim, kind, 0)
    high = F.shiftrightunsigned("hash", 32)
    rows = rows.withColumn("shard", F.shiftright(high * shards, 32).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tables, shard = [], [], None
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                keys.append(batch.column("hash").to_numpy().view(np.uint64))
                tables.append(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dim))
        if shard is not None:
            key, table = np.concatenate(keys), np.concatenate(tables)
            order = np.lexsort((*table.T[::-1], key))
            key, first = np.unique(key[order], return_index=True)
            _save(folder, f"{shard}.keys.npy", key)
            _save(folder, f"{shard}.table.npy", np.ascontiguousarray(table[order[first]], kind))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(key)], pa.int64())})

    dealt = rows.select("shard", "hash", "vector").repartitionById(shards, F.col("shard"))
    written = {r["shard"]: r["words"] for r in dealt.mapInArrow(write, "shard int, words long").collect()}  # a row a shard
    for k in set(range(shards)) - set(written):
        _save(folder, f"{k}.keys.npy", np.zeros(0, np.uint64))
        _save(folder, f"{k}.table.npy", np.zeros((0, dim), kind))
    return VectorStore(folder, shards, dim, kind, sum(written.values()))
