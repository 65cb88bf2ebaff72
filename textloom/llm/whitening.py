"""Embedding whitening by a compensated covariance.

Rows. A vector counts if it is not null and holds no null, NaN or infinite entry; the others are dropped. Entry c
becomes the long x = floor(1024 * c) + 100000. Sums S of each dimension are exact longs.

Covariance. A pair (high, low) of doubles stands for their unrounded sum. The mean is such a pair; each row is
centred by it, and products of centred entries are made without error (the product and its rounding error, by
splitting the factors) and added pair by pair with error-free sums, halving the rows of a batch until one is left.
A task sends one pair of arrays a dimension; they are merged in two steps, by (dimension, salt) and by dimension,
each a stream that holds one row of the matrix. About 105 bits are kept, so neither the offset nor the order of
rows shows in the result. The driver receives d * d pairs: its bound is the dimension, not the rows.

Components. Householder tridiagonalisation and divide and conquer (numpy's ``eigh``) give the eigenvectors; two steps
of refinement in extended precision on the scaled pairs bring them to double precision. A component's sign makes its
largest entry positive. Components are numbered from 1 by falling eigenvalue, equal ones in any order.

Projection. A row is centred exactly as (n * x - S) / n before it is projected. ``deviation`` is an exact integer; one
that no long can hold raises an error. A component without variance (eigenvalue at most 1e-25 of the trace) is
constant: its ``whitened`` is null, and it takes no part in ``identity_error``, which is 0.0 if no component does.

Empty vectors are kept and give no rows; vectors of different lengths raise an error, as do entries whose x is no
long. Null ids, repeated rows and extra columns pass through; columns named like an output are replaced. Without any
remaining vector there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names

SCALE, OFFSET = 1024, 100_000
SALTS = 32
ROWS = 256  # rows whose products are made at once
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error, the factors split into halves of 26 bits."""
    p = a * b
    big = 134217729.0 * a
    a1 = big - (big - a)
    big = 134217729.0 * b
    b1 = big - (big - b)
    a2, b2 = a - a1, b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add_pairs(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sum_rows(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum over axis 0 of pairs, halving the rows."""
    while len(high) > 1:
        half = len(high) // 2
        rest = (high[2 * half :], low[2 * half :])
        high, low = add_pairs((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        if len(rest[0]):
            high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return high[0], low[0]


def outer_sums(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum over rows of each row's outer product with itself (upper half), from rows of pairs."""
    d = high.shape[1]
    out = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        p, e = two_product(high[:, i : i + 1], high[:, i:])
        e = e + (high[:, i : i + 1] * low[:, i:] + low[:, i : i + 1] * high[:, i:])
        out[0][i, i:], out[1][i, i:] = sum_rows(p, e)
    return out


def mean_pair(sums: list[int], n: int) -> Pair:
    """S / n of exact integers as pairs."""
    high = np.array([s / n for s in sums], np.float64)
    low = np.array([_rest(s, n, h) for s, h in zip(sums, high.tolist())], np.float64)
    return high, low


def _rest(s: int, n: int, high: float) -> float:
    top, bottom = high.as_integer_ratio()
    return (s * bottom - top * n) / (n * bottom)


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """A batch of equally long lists as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def covariance_sums(df: DataFrame, column: str, mean: Pair) -> Pair:
    """The sums of centred outer products over df's arrays (longs or doubles), as a matrix of pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column(0), dtype)
            for begin in range(0, len(x), ROWS):
                rows = x[begin : begin + ROWS]
                high, low = two_sum(rows.astype("f8"), -mean[0])
                # A long beyond 2 ** 53 is more than its double.
                high, low = two_sum(high, low + (rows - rows.astype("f8").astype(dtype)) - mean[1])
                part = outer_sums(high, low)
                total = part if total is None else add_pairs(total, part)
        if total is not None and len(total[0]):
            yield _packed(list(range(len(total[0]))), list(total[0]), list(total[1]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:  # sorted by place
            for k, high, low in zip(batch.column("i").to_pylist(), batch.column("high"), batch.column("low")):
                part = np.frombuffer(high.as_buffer()), np.frombuffer(low.as_buffer())
                if k != place:
                    if place is not None:
                        yield _packed([place], [total[0]], [total[1]])
                    place, total = k, part
                else:
                    total = add_pairs(total, part)
        if place is not None:
            yield _packed([place], [total[0]], [total[1]])

    d = len(mean[0])
    dtype = "i8" if df.schema[column].dataType.elementType == T.LongType() else "f8"
    schema = "i int, high binary, low binary"
    parts = df.select(column).mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = parts.repartition("i", "salt").sortWithinPartitions("i").select("i", "high", "low").mapInArrow(merge, schema)
    rows = salted.repartition("i").sortWithinPartitions("i").mapInArrow(merge, schema).collect()  # d rows
    out = np.zeros((d, d)), np.zeros((d, d))
    for row in rows:
        out[0][row["i"]], out[1][row["i"]] = np.frombuffer(row["high"]), np.frombuffer(row["low"])
    return tuple(np.triu(m) + np.triu(m, 1).T for m in out)


def _packed(places: list[int], high: list[np.ndarray], low: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(places, pa.int32()), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (high, low))]
    return pa.RecordBatch.from_arrays(arrays, names=["i", "high", "low"])


def components(sums: Pair, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (columns) and the trace of sums / n, all in extended precision."""
    v = (sums[0].astype(np.longdouble) + sums[1]) / n
    size = np.abs(v).max(initial=0)
    if not size:
        return np.zeros(len(v), np.longdouble), np.eye(len(v), dtype=np.longdouble), 0.0
    scaled = v / size
    values, vectors = np.linalg.eigh(scaled.astype(np.float64))
    vectors = vectors.astype(np.longdouble)
    for _ in range(2):
        values, vectors = _refined(scaled, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)
    return values * size, vectors * np.where(largest < 0, -1, 1), float(np.trace(v))


def _refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step that squares the error of nearly orthonormal eigenvectors x of v."""
    off, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
    values = np.diag(s) / (1 - np.diag(off))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= 2 * np.linalg.norm((s - np.diag(values)).astype(np.float64)) + 1e-15
    step = np.where(near, off / 2, (s + values[None, :] * off) / np.where(near, 1, gap))
    return values, x + x @ step


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    vectors: np.ndarray  # d x k
    values: np.ndarray
    explained: np.ndarray


def clean(df: DataFrame, vector: str, x: str) -> DataFrame:
    """The rows that count, with their longs in column x."""
    good = F.col(vector).isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    long = lambda c: F.when(F.abs(c) < 9e15, F.floor(F.lit(float(SCALE)) * c) + F.lit(OFFSET)).otherwise(
        F.raise_error(F.lit("an entry is too large for a long"))
    )
    return df.filter(F.coalesce(good, F.lit(False))).withColumn(x, F.transform(vector, lambda c: long(c.cast("double"))))


def exact_sums(rows: DataFrame, x: str) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of their dimensions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            if len(set(lengths.tolist())) > 1:
                raise ValueError("vectors of different lengths")
            part = matrix(batch.column(0), "i8")
            if len(part):
                n += len(part)
                total[part.shape[1]] = [a + b for a, b in zip(total.get(part.shape[1], [0] * part.shape[1]), part.sum(0).tolist())]
        for d, sums in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([sums], pa.list_(pa.int64()))})

    parts = rows.select(x).mapInArrow(count, "d int, n long, s array<long>")
    counted = parts.groupBy("d").agg(F.sum("n").alias("n")).take(2)
    if len(counted) > 1:
        raise ValueError("vectors of different lengths")
    sums = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # d rows
    return (counted[0]["n"] if counted else 0), [int(r["v"]) for r in sorted(sums, key=lambda r: r["i"])]


def fit(rows: DataFrame, x: str, most: int = 8) -> Whitening:
    """The mean and the first components of the longs in column x."""
    n, sums = exact_sums(rows, x)
    d = len(sums)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    values, vectors, trace = components(covariance_sums(rows, x, mean_pair(sums, n)), n)
    k = min(most, d)
    values = np.where(values[:k] > 1e-25 * trace, values[:k], 0)
    explained = values / trace if trace else np.zeros(k)
    return Whitening(n, sums, vectors[:, :k].astype(np.float64), values.astype(np.float64), explained.astype(np.float64))


def _project(model: Whitening) -> Callable[[np.ndarray], tuple[list[int], np.ndarray]]:
    n, sums = model.n, np.array(model.sums, np.int64)
    used = model.values > 0
    weights = model.vectors[:, used] / np.sqrt(model.values[used])

    def run(x: np.ndarray) -> tuple[list[int], np.ndarray]:
        # n * x - S as n * (x - q) - r, with S = n * q + r: small enough for longs unless entries are huge.
        q, r = sums // n, sums % n
        away = x - q
        far = int(np.abs(away).max(initial=0)) * n + n
        if far < (1 << 62) and far * far * max(1, x.shape[1]) < (1 << 63):
            exact = away * n - r
            return (exact * exact).sum(1).tolist(), (exact.astype(np.float64) / n) @ weights
        exact = away.astype(object) * n - r.astype(object)
        deviation = (exact * exact).sum(1).tolist()
        if max(deviation) >= 1 << 63:
            raise OverflowError("deviation doesn't fit a long")
        return deviation, (exact / n).astype(np.float64) @ weights

    return run


def whiten(df: DataFrame, vector: str = "embedding", most: int = 8) -> DataFrame:
    """The rows of df that count, without the vector, with ``components``: an array of structs (component, whitened,
    explained), and ``n``, ``deviation`` and ``identity_error``."""
    spark = df.sparkSession
    (x,) = free_names(df, "_x")
    rows = clean(df, vector, x)
    model = fit(rows, x, most)
    used = np.flatnonzero(model.values > 0)
    run = _project(model) if model.n and len(model.sums) else None
    kept = [f for f in df.schema if f.name.lower() not in {"n", "deviation", "whitened", "explained", "identity_error", "component", vector.lower()}]
    schema = T.StructType([*kept, T.StructField("deviation", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, scores = run(matrix(batch.column(x), "i8")) if run else ([0] * len(batch), np.zeros((len(batch), 0)))
            width = scores.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * width, pa.int32()), pa.array(scores.ravel()))
            arrays = [*(batch.column(f.name) for f in kept), pa.array(deviation, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in kept), "deviation", "scores"])

    scored = rows.select(*(f.name for f in kept), x).mapInArrow(project, schema)
    error = _identity_error(scored, len(used))
    place = {int(k): j for j, k in enumerate(used)}
    parts = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.get("scores", F.lit(place[k])) if k in place else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(model.explained[k])).alias("explained"),
        )
        for k in range(len(model.values))
    ]
    empty = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    return scored.withColumns({"components": F.array(*parts) if parts else empty, "n": F.lit(model.n).cast("long"), "identity_error": F.lit(error)}).drop("scores")


def _identity_error(scored: DataFrame, k: int) -> float:
    """The largest entry of the covariance of scores minus the identity, over all rows."""
    if not k:
        return 0.0
    at = [F.get("scores", F.lit(j)) for j in range(k)]
    first = scored.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{j}") for j, c in enumerate(at))).first()
    mean = np.array([first[f"m{j}"] for j in range(k)])
    sums = covariance_sums(scored, "scores", (mean, np.zeros(k)))
    return float(np.abs((sums[0] + sums[1]) / first["n"] - np.eye(k)).max())
