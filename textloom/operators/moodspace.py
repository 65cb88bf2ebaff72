"""A low-dimensional map of moods from counts per user: factors, whitening, independent components, two axes.

Users are many and moods are few. What reaches the driver are moment matrices of rank by rank, or of moods by rank,
which don't grow with the users.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage


SAMPLE = 1000


def _dot(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def nmf(counts: DataFrame, moods: Sequence[str], rank: int = 6, passes: int = 10, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Non-negative factors: users (user, f0…) and moods (moods x rank), by multiplicative updates.

    counts is wide: a user column and one column a mood (see features.mood_table). Each pass is one map over users
    and one aggregation of moods x rank + rank x rank sums.
    """
    user = next(c for c in counts.columns if c not in moods)
    w = np.random.default_rng(seed).uniform(0.1, 1.0, (len(moods), rank))
    names = [f"f{k}" for k in range(rank)]
    rows = counts.select(user, *(F.col(m).cast("double").alias(f"x{i}") for i, m in enumerate(moods)), *(F.lit(1.0).alias(f) for f in names))
    xs = [f"x{i}" for i in range(len(moods))]
    for k in range(passes):
        gram = w.T @ w
        updated = [F.col(f) * _dot(xs, w[:, j]) / (_dot(names, gram[:, j]) + 1e-9) for j, f in enumerate(names)]
        rows = rows.select(user, *xs, *(u.alias(f) for u, f in zip(updated, names, strict=True)))
        if k % 3 == 2 or k == passes - 1:
            rows = cut_lineage(rows)
        sums = rows.agg(
            *(F.sum(F.col(x) * F.col(f)).alias(f"a{i}_{j}") for i, x in enumerate(xs) for j, f in enumerate(names)),
            *(F.sum(F.col(f) * F.col(g)).alias(f"b{i}_{j}") for i, f in enumerate(names) for j, g in enumerate(names)),
        ).first()
        if sums["b0_0"] is None:
            break
        a = np.array([[sums[f"a{i}_{j}"] for j in range(rank)] for i in range(len(moods))])
        b = np.array([[sums[f"b{i}_{j}"] for j in range(rank)] for i in range(rank)])
        w = w * a / (w @ b + 1e-9)
    return rows.select(user, *names), w


def _far_apart(rows: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Directions of rows, as columns: the row that is left longest when those chosen are projected out, again and again."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    rest, chosen = unit.copy(), []
    for _ in range(rank):
        lengths = np.linalg.norm(rest, axis=1)
        if not len(lengths) or lengths.max() < 1e-6:
            break
        best = int(lengths.argmax())
        chosen.append(unit[best])
        axis = rest[best] / lengths[best]
        rest = rest - np.outer(rest @ axis, axis)
    spare = np.random.default_rng(seed).normal(size=(rank - len(chosen), rows.shape[1]))
    return np.array([*chosen, *(x / np.linalg.norm(x) for x in spare)]).T


def sfa(counts: DataFrame, moods: Sequence[str], rank: int = 6, passes: int = 30, penalty: float = 0.1, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Sparse factors: users (user, f0…), many of them 0, and moods (moods x rank, columns of length 1).

    The fit of counts by factors plus ``penalty`` times the sum of their absolute values falls with every pass: users take two
    soft-thresholded gradient steps each (one expression a factor, no shuffle), then moods are solved by least squares
    from sums of moods x rank + rank x rank, which is all that reaches the driver. Passes start from ``rank`` users of a
    sample of ``SAMPLE``, each as far as can be from those chosen before.
    """
    user = next(c for c in counts.columns if c not in moods)
    if rank > len(moods):
        raise ValueError("more factors than moods")
    some = counts.select(*(F.col(m).cast("double") for m in moods), F.xxhash64(user, F.lit(seed)).alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()
    w = _far_apart(some[list(moods)].to_numpy(), rank, seed)
    names, xs = [f"f{k}" for k in range(rank)], [f"x{i}" for i in range(len(moods))]
    rows = counts.select(user, *(F.col(m).cast("double").alias(x) for x, m in zip(xs, moods)), *(F.lit(0.0).alias(f) for f in names))
    scale = np.ones(rank)
    for k in range(passes):
        gram = w.T @ w
        step = 1 / max(np.linalg.eigvalsh(gram).max(), 1e-12)
        for _ in range(2):
            made = []
            for j in range(rank):
                slope = sum((F.col(f) * F.lit(float(gram[i, j] * scale[i])) for i, f in enumerate(names)), F.lit(0.0)) - _dot(xs, w[:, j])
                moved = F.col(names[j]) * float(scale[j]) - slope * float(step)
                made.append(F.signum(moved) * F.greatest(F.abs(moved) - F.lit(float(penalty * step)), F.lit(0.0)))
            rows = rows.select(user, *xs, *(m.alias(f) for m, f in zip(made, names, strict=True)))
            scale = np.ones(rank)
        if k % 3 == 2 or k == passes - 1:
            rows = cut_lineage(rows)
        if k == passes - 1:
            break
        sums = rows.agg(
            *(F.sum(F.col(x) * F.col(f)).alias(f"a{i}_{j}") for i, x in enumerate(xs) for j, f in enumerate(names)),
            *(F.sum(F.col(f) * F.col(g)).alias(f"b{i}_{j}") for i, f in enumerate(names) for j, g in enumerate(names)),
        ).first()
        if sums["b0_0"] is None:
            break
        a = np.array([[sums[f"a{i}_{j}"] for j in range(rank)] for i in range(len(moods))])
        b = np.array([[sums[f"b{i}_{j}"] for j in range(rank)] for i in range(rank)])
        used = np.diag(b) > 0
        new = w.copy()
        new[:, used] = np.linalg.solve(b[np.ix_(used, used)] + 1e-9 * np.trace(b) * np.eye(used.sum()), a[:, used].T).T
        length = np.maximum(np.linalg.norm(new, axis=0), 1e-12)
        w, scale = new / length, length
    return rows.select(user, *names), w


def als(counts: DataFrame, rank: int = 6, nonnegative: bool = True, passes: int = 10, seed: int = 42) -> ALSModel:
    """Sparse factors of (user_id, mood_id, cnt)."""
    return ALS(rank=rank, maxIter=passes, nonnegative=nonnegative, userCol="user_id", itemCol="mood_id", ratingCol="cnt", seed=seed).fit(counts)


def lda(vectors: DataFrame, topics: int = 6, passes: int = 10, seed: int = 42) -> LDAModel:
    """Topics of users' mood counts; vectors has a features column."""
    return LDA(k=topics, maxIter=passes, seed=seed).fit(vectors)


def moments(rows: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of rows."""
    n = len(columns)
    got = rows.agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)),
        *(F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i),
    ).first()
    number = lambda x: 0.0 if x is None or x != x else float(x)
    cov = np.array([[number(got[f"c{min(i, j)}_{max(i, j)}"]) for j in range(n)] for i in range(n)])
    return np.array([number(got[f"m{i}"]) for i in range(n)]), cov, got["n"]


def whiten(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """rows with w0, w1, … of unit covariance, and the whitening matrix. Directions without variance become 0."""
    mean, cov, _ = moments(rows, columns)
    values, axes = np.linalg.eigh(cov)
    root = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    w = axes @ np.diag(root) @ axes.T
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    made = [sum((x * F.lit(float(v)) for x, v in zip(centred, row, strict=True)), F.lit(0.0)) for row in w]
    return rows.select("*", *(x.alias(f"w{i}") for i, x in enumerate(made))), w


def ica(rows: DataFrame, columns: Sequence[str], passes: int = 25, seed: int = 42) -> np.ndarray:
    """The unmixing matrix of whitened columns: symmetric fixed-point steps with the Gaussian contrast.

    Each step is one aggregation: E[x g(w x)] and E[g'(w x)] with g(u) = u exp(-u²/2).
    """
    n = len(columns)
    orthogonal = lambda m: (lambda u, _, v: u @ v)(*np.linalg.svd(m))
    w = orthogonal(np.random.default_rng(seed).normal(size=(n, n)))
    for _ in range(passes):
        cells = []
        for i in range(n):
            u = _dot(columns, w[i])
            bell = F.exp(-u * u / 2)
            cells += [F.avg(F.col(c) * u * bell).alias(f"a{i}_{j}") for j, c in enumerate(columns)] + [F.avg((1 - u * u) * bell).alias(f"b{i}")]
        got = rows.agg(*cells).first()
        if got["b0"] is None:
            return w
        new = orthogonal(np.array([[got[f"a{i}_{j}"] - got[f"b{i}"] * w[i, j] for j in range(n)] for i in range(n)]))
        still = np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1)) < 1e-8
        w = new
        if still:
            break
    return w


def signal_energy(rows: DataFrame, columns: Sequence[str], unmixing: np.ndarray, whitening: np.ndarray) -> np.ndarray:
    """How much of the data each component carries: its mixing column's squared length times its energy."""
    mixing = np.linalg.pinv(unmixing @ whitening)
    got = rows.agg(*(F.sum(F.pow(_dot(columns, unmixing[i]), 2)).alias(f"e{i}") for i in range(len(columns)))).first()
    return np.array([float(got[f"e{i}"] or 0.0) * float(mixing[:, i] @ mixing[:, i]) for i in range(len(columns))])


def mood_map(factors: np.ndarray, unmixing: np.ndarray, whitening: np.ndarray, energy: np.ndarray, moods: Sequence[str]) -> list[tuple[str, float, float]]:
    """(mood, x, y): mood factors along the mixing directions of the two strongest components."""
    mixing = np.linalg.pinv(unmixing @ whitening)
    first, second = np.argsort(-energy, kind="stable")[:2]
    return [(m, float(row @ mixing[:, first]), float(row @ mixing[:, second])) for m, row in zip(moods, factors, strict=True)]


def build_map(counts: DataFrame, moods: Sequence[str], rank: int = 3, passes: int = 10, seed: int = 42) -> DataFrame:
    """From wide counts per user to (mood, x, y)."""
    users, factors = nmf(counts, moods, rank, passes, seed)
    names = [f"f{k}" for k in range(rank)]
    white, w = whiten(users, names)
    columns = [f"w{k}" for k in range(rank)]
    white = cut_lineage(white)
    unmixing = ica(white, columns, seed=seed)
    energy = signal_energy(white, columns, unmixing, w)
    return counts.sparkSession.createDataFrame(mood_map(factors, unmixing, w, energy, moods), "mood string, x double, y double")
