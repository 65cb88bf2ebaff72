"""Factors, topics, components and the mood map against what was planted."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.operators import moodspace as MS

MOODS = [f"m{k}" for k in range(8)]


def wide(spark, table):
    rows = [(k, *map(float, r)) for k, r in enumerate(table)]
    return spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{m} double" for m in MOODS)).repartition(3)


def matched(found, planted):
    """The best cosine of each planted column."""
    f = found / np.maximum(np.linalg.norm(found, axis=0), 1e-12)
    p = planted / np.linalg.norm(planted, axis=0)
    return np.abs(p.T @ f).max(1)


@pytest.fixture(scope="module")
def planted():
    """Each mood belongs to one of three factors, each user to one or two."""
    rng = np.random.default_rng(4)
    w = np.zeros((8, 3))
    w[[0, 1, 2], 0], w[[3, 4, 5], 1], w[[6, 7], 2] = (3, 2, 1), (2, 2, 1), (3, 1)
    u = rng.exponential(2, (300, 3)) * (rng.random((300, 3)) < 0.45)
    u[u.sum(1) == 0, 0] = 1
    return w, u


def test_factors_are_found_again(spark, planted):
    w, u = planted
    users, found = MS.nmf(wide(spark, u @ w.T), MOODS, rank=3, passes=40)
    assert (matched(found, w) > 0.97).all() and (found >= 0).all() and users.count() == 300


def test_sparse_factors_are_found_again_and_are_sparse(spark, planted):
    w, u = planted
    noise = np.random.default_rng(5).normal(0, 0.05, (300, 8))
    users, found = MS.sfa(wide(spark, u @ w.T + noise), MOODS, rank=3, passes=30, penalty=0.5)
    assert (matched(found, w) > 0.97).all() and np.allclose(np.linalg.norm(found, axis=0), 1, atol=1e-6)
    table = users.orderBy("user_id").toPandas()[["f0", "f1", "f2"]].to_numpy()
    assert abs((table == 0).mean() - (u == 0).mean()) < 0.1
    fit = table @ found.T
    assert np.linalg.norm(fit - u @ w.T) < 0.25 * np.linalg.norm(u @ w.T)
    none, _ = MS.sfa(wide(spark, u @ w.T).limit(0), MOODS, rank=3, passes=2)
    assert none.count() == 0


def test_topics_part_users_by_their_moods(spark, planted):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w, _ = planted
    table = np.repeat((w * 10).T, 40, axis=0)
    ready = VectorAssembler(inputCols=MOODS, outputCol="features").transform(wide(spark, table))
    got = MS.lda(ready, topics=3, passes=30).transform(ready).select("user_id", vector_to_array("topicDistribution").alias("t")).collect()
    best = {r["user_id"]: int(np.argmax(r["t"])) for r in got}
    groups = [{best[k] for k in range(g * 40, g * 40 + 40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


@pytest.fixture(scope="module")
def signals(spark):
    """Three independent signals of unequal strength, mixed."""
    rng = np.random.default_rng(6)
    s = np.column_stack([rng.uniform(-1, 1, 2500), rng.laplace(size=2500), rng.choice([-1.0, 1.0], 2500)]) * [1, 2, 4]
    mixing = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    x = s @ mixing.T
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double, c double").repartition(3).persist()
    white, whitening = MS.whiten(df, ["a", "b", "c"])
    names = ["w0", "w1", "w2"]
    unmixing = MS.ica(white, names)
    return s, mixing, white, whitening, unmixing, names


def test_independent_signals_are_found_again(signals):
    s, _, white, _, unmixing, names = signals
    w = white.orderBy("k").toPandas()[names].to_numpy()
    found = w @ unmixing.T
    corr = np.abs(np.corrcoef(s.T, found.T)[:3, 3:])
    assert (corr.max(1) > 0.97).all() and sorted(corr.argmax(1)) == [0, 1, 2]
    assert np.allclose(unmixing @ unmixing.T, np.eye(3), atol=1e-8)


def test_energy_ranks_signals_by_their_strength(signals):
    s, _, white, whitening, unmixing, names = signals
    energy = MS.signal_energy(white, names, unmixing, whitening)
    w = white.orderBy("k").toPandas()[names].to_numpy()
    of = np.abs(np.corrcoef(s.T, (w @ unmixing.T).T)[:3, 3:]).argmax(0)
    # Uniform: variance 1/3; Laplace of scale 2: 8; two values of 4: 16.
    assert list(of[np.argsort(-energy)]) == [2, 1, 0]
    assert np.isclose(energy.sum(), 2499 * np.var(s, axis=0, ddof=1).sum(), rtol=0.02)


def test_map_lays_moods_along_the_two_strongest(signals):
    _, _, white, whitening, unmixing, names = signals
    energy = MS.signal_energy(white, names, unmixing, whitening)
    mixing = np.linalg.pinv(unmixing @ whitening)
    first, second = np.argsort(-energy)[:2]
    got = MS.mood_map(mixing.T, unmixing, whitening, energy, ["p", "q", "r"])
    for (name, x, y), row in zip(got, mixing.T):
        assert np.isclose(x, row @ mixing[:, first]) and np.isclose(y, row @ mixing[:, second])
    # A mood that is the strongest direction itself lies on the first axis, as directions are orthogonal here.
    strongest = got[first]
    assert abs(strongest[1]) > 5 * abs(strongest[2])


def test_map_of_planted_groups(spark, planted):
    w, u = planted
    got = {r["mood"]: np.array([r["x"], r["y"]]) for r in MS.build_map(wide(spark, u @ w.T), MOODS, rank=3, passes=20).collect()}
    assert set(got) == set(MOODS)
    unit = {m: v / np.linalg.norm(v) for m, v in got.items()}
    groups = ["m0 m1 m2".split(), "m3 m4 m5".split(), "m6 m7".split()]
    # Moods of one factor lie in one direction.
    for group in groups:
        assert all(unit[group[0]] @ unit[m] > 0.9 for m in group)


def test_als_gives_what_it_was_given(spark, planted):
    w, u = planted
    table = u @ w.T
    flat = [(i, j, float(table[i, j])) for i in range(0, 300) for j in range(8)]
    model = MS.als(spark.createDataFrame(flat, "user_id int, mood_id int, cnt double"), rank=3, passes=15)
    got = model.transform(spark.createDataFrame(flat, "user_id int, mood_id int, cnt double"))
    far = np.abs(table - table.mean()).mean()
    assert got.agg(F.avg(F.abs(F.col("prediction") - F.col("cnt")))).first()[0] < far / 2
