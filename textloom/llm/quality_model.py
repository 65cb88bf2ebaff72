"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network.

Word vectors. Words and word shapes are hashed to ``BUCKETS`` rows (words that share one share a vector). Every row
has a fixed sparse ternary index vector; a row's word vector is the normalised sum of the index vectors of its
neighbours (``WINDOW`` words to either side), gathered over all documents, plus its own index vector. Tasks sum
in integers; the partial sums are added in ``BLOCKS`` blocks of rows, streamed, by (block, salt) first where there are
many tasks, so the vectors don't depend on how rows are dealt. A document's vector is the mean over its words, the mean over its shapes, and a few ratios.

Network. Two layers in numpy (tanh, sigmoid), trained by Adam; a held-out fifth of the training rows sets the
temperature by which logits are divided, so that scores are probabilities.

Only the network's training is bounded: at most ``max_labelled`` labels, those of least hash, are learnt from (a
documented parameter), each with one document: of several with its id, that of least text. Every document is
scored, over its whole text, in Arrow batches; what is sent to the executors is the table of word vectors
(BUCKETS x DIM half-precision floats, 8 MB) and the weights.

A null or empty text has zero vectors and is scored like any other. Labels that are null are ignored; repeated
labels count as often as they occur. Ids may be of any type that sorts. Without any label of both classes every
score is the share of label 1 (0.5 if there is none). Extra columns pass through, those named like an output are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import arrow_batches, pooled, split_words

BUCKETS, DIM, NONZERO, WINDOW = 1 << 16, 64, 6, 2
BLOCKS = 16
SLICE = 50_000  # words whose contexts are gathered at once
SHAPES, SHAPE_DIM = 1 << 10, 32
#: Character classes of a word's shape; other bytes stand for themselves.
_CLASS = bytes(
    97 if chr(b).islower() and b < 128 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)
RATIOS = 6


def index_vectors(rows: int, dim: int, seed: int) -> np.ndarray:
    """A sparse ternary vector for each row, the same on every machine."""
    rng = np.random.default_rng(seed)
    table = np.zeros((rows, dim), np.float32)
    places = rng.integers(0, dim, (rows, NONZERO))
    np.put_along_axis(table, places, rng.choice(np.float32([-1, 1]), (rows, NONZERO)), 1)
    return table


def _words(text: str) -> list[bytes]:
    return text.encode().split()


def _rows(words: list[bytes]) -> np.ndarray:
    return (np.fromiter((zlib.crc32(w.lower()) for w in words), np.int64, len(words)) % BUCKETS).astype(np.uint16)


class Model(NamedTuple):
    vectors: np.ndarray
    weights: tuple[np.ndarray, ...]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float
    prior: float


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    shapes = index_vectors(SHAPES, SHAPE_DIM, 2)
    out = np.zeros((len(texts), DIM + SHAPE_DIM + RATIOS), np.float32)
    for k, text in enumerate(texts):
        counts = Counter(_words(text))
        if not counts:
            continue
        words = list(counts)
        n = np.fromiter(counts.values(), np.float32, len(words))
        total = n.sum()
        pooled = (n @ vectors[_rows(words)].astype(np.float32)) / total
        ends = [(t := w.translate(_CLASS))[:1] + t[-3:] for w in words]
        shape = np.fromiter(map(zlib.crc32, ends), np.int64, len(words)) % SHAPES
        pooled_shape = (n @ shapes[shape]) / total
        lines = text.split("\n")
        out[k, :DIM] = pooled
        out[k, DIM : DIM + SHAPE_DIM] = pooled_shape
        out[k, DIM + SHAPE_DIM :] = (
            np.log1p(total),
            len(words) / total,
            len(text) / total / 10,
            len(set(lines)) / len(lines),
            float(n.max()) / total,
            float(np.linalg.norm(pooled)),
        )
    return out


def _context_sums(texts: pa.Array, sums: np.ndarray, index: np.ndarray) -> None:
    """Add to each word's row the index vectors of its neighbours in the same text."""
    words, codes, lengths = split_words(texts)
    rows, text = _rows(words)[codes], np.repeat(np.arange(len(lengths)), lengths)
    for begin in range(0, len(rows), SLICE):
        stop = min(begin + SLICE, len(rows))
        own, around = rows[begin:stop], np.zeros((stop - begin, DIM), np.int8)
        for gap in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            at = np.arange(max(begin, -gap), min(stop, len(rows) - max(gap, 0)))
            at = at[text[at] == text[at + gap]]
            around[at - begin] += index[rows[at + gap]]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        sums[own[order[first]]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """The table of word vectors over all documents: each task returns one partial sum, block by block."""
    rows = BUCKETS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, index = np.zeros((BUCKETS, DIM), np.int32), index_vectors(BUCKETS, DIM, 1).astype(np.int8)
        some = False
        for batch in pooled(batches, 2 << 20):
            _context_sums(batch.column(0), sums, index)
            some = True
        for k in range(BLOCKS if some else 0):
            # Byte by byte: most sums are small, and equal bytes compress.
            part = sums[k * rows : (k + 1) * rows].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "sums": pa.array([part], pa.binary())})

    def adder(width: int, last: bool):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, block = np.zeros(rows * DIM, np.int64), None
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    block = k
                    total += np.ascontiguousarray(np.frombuffer(part.as_buffer(), np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel()
            if block is not None:
                part = _finished(total.reshape(rows, DIM), block) if last else total.view(np.uint8).reshape(-1, 8).T
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

        return add

    schema = "block int, sums binary"
    parts, width, salts = docs.select(text).mapInArrow(count, schema), 4, adding_salts(docs.rdd.getNumPartitions())
    if salts > 1:
        salted = parts.repartitionById(BLOCKS * salts, F.col("block") * salts + F.spark_partition_id() % salts)
        parts, width = salted.mapInArrow(adder(4, False), schema), 8
    vectors = np.concatenate([_finished(np.zeros((rows, DIM), np.int64), k) for k in range(BLOCKS)])
    for row in parts.repartitionById(BLOCKS, F.col("block")).mapInArrow(adder(width, True), schema).toLocalIterator():  # BLOCKS rows, 8 MB
        vectors[row["block"] * rows : (row["block"] + 1) * rows] = np.frombuffer(row["sums"], np.float16).reshape(rows, DIM)
    return vectors


def _finished(sums: np.ndarray, block: int) -> np.ndarray:
    """A block's vectors from its sums: normalised, with each row's own index vector."""
    own = index_vectors(BUCKETS, DIM, 1)[block * len(sums) : (block + 1) * len(sums)]
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + own / np.sqrt(NONZERO)).astype(np.float16)


def adding_salts(tasks: int) -> int:
    """Into how many parts the sums of so many tasks are added first: 1 for a few hundred, then with the root."""
    return max(1, round(tasks**0.5 / 4)) if tasks > 256 else 1


def _logit(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gradients(weights: list[np.ndarray], a: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """Of the mean log-loss and a decay of 1e-4, over some rows."""
    h = np.tanh(a @ weights[0] + weights[1])
    d = (_sigmoid(h @ weights[2] + weights[3]) - t) / max(1, len(t))
    back = np.outer(d, weights[2]) * (1 - h * h)
    return [a.T @ back + 1e-4 * weights[0], back.sum(0), h.T @ d + 1e-4 * weights[2], d.sum()]


def _log_loss(logits: np.ndarray, t: np.ndarray) -> float:
    return float(-np.mean(np.log(np.where(t == 1, _sigmoid(logits), _sigmoid(-logits)) + 1e-12)))


def _temperature(logits: np.ndarray, t: np.ndarray) -> float:
    """By which logits are divided for the least log-loss, from 1/4 to 8 in steps of 6 percent."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    return float(min(grid, key=lambda k: _log_loss(logits / k, t))) if len(t) else 1.0


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 12, seed: int = 7) -> Model:
    prior = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(())]
    if len(set(y.tolist())) < 2:
        return Model(vectors, tuple(weights), mean, scale, 0.0, prior)
    z = (x - mean) / scale
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(max(epochs, 4000 // max(1, len(used) // 256 + 1))):
        for rows in np.array_split(rng.permutation(used), len(used) // 256 + 1):
            step += 1
            for k, g in enumerate(_gradients(weights, z[rows], y[rows])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(vectors, tuple(weights), mean, scale, _temperature(_logit(z[held], tuple(weights)), y[held]), prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_labelled: int = 20_000) -> Model:
    """labels: doc_id and the label column; at most max_labelled of them (of least hash) are learnt from."""
    arrow_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = cut_lineage(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_labelled))
    slim = docs.select("doc_id", F.col(text).alias("_text"))
    one = slim.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_text").alias("_text"))
    sample = one.join(F.broadcast(chosen), "doc_id")
    vectors = word_vectors(slim, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or "" for t in batch.column(0).to_pylist()], shared.value)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column(1)], names=["x", "y"])

    got = sample.select("_text", "_y").mapInArrow(run, "x binary, y int").toPandas().sort_values(["x", "y"])
    width = DIM + SHAPE_DIM + RATIOS
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width).astype(np.float64)
    return train(x, got["y"].to_numpy(np.float64), vectors)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with ``out``: the calibrated probability of label 1."""
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = features([t or "" for t in batch.column(text).to_pylist()], m.vectors).astype(np.float64)
            p = _sigmoid(_logit((x - m.mean) / m.scale, m.weights) / m.temperature) if m.temperature else np.full(len(x), m.prior)
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(p, pa.float64())], names=[*keep, out])

    fields = [f for f in df.schema if f.name != out]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def fold(folds: int = 5, column: str = "doc_id"):
    """The remainder of crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))
