from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tests.oracle import DATA
from textloom.llm import whitening as w
from textloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def longs(vectors):
    return np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000


def brute(vectors, most=8):
    """Plain numpy over all rows: components, whitened values, shares, exact deviations."""
    x = longs(vectors)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(Fraction(n * int(a) - int(s), n)) for a, s in zip(r, sums)] for r in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(most, len(values))
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    return centred @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), deviation


def test_query_equals_brute_force(spark):
    from textloom.llm.common import table

    got = QUERIES["op13_whitening"](spark, DATA).toPandas().sort_values(["vec_id", "component"])
    source = table(spark, DATA, "embeddings").orderBy("vec_id").toPandas()
    white, explained, deviation = brute(source["embedding"].tolist())
    assert len(got) == 8 * len(source) and set(got["n"]) == {len(source)}
    ours = got["whitened"].to_numpy().reshape(len(source), 8)
    assert np.abs(np.abs(ours) - np.abs(white)).max() < 1e-9
    signs = np.sign(ours) * np.sign(white)
    assert (np.abs(signs.sum(0)) == len(source)).all()  # one sign a component
    assert np.allclose(got["explained"].to_numpy()[:8], explained, rtol=1e-9)
    assert got["deviation"].tolist()[::8] == deviation
    assert got["identity_error"].max() < 1e-9


def test_sums_are_exact_where_doubles_are_not(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, (301, 4)) + np.array([10**15, 10**12, 100_000, 7])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7)
    n, sums = w.exact_sums(df, "x")
    assert (n, sums) == (301, [int(s) for s in x.sum(0)])
    high, low = w.covariance_sums(df, "x", w.mean_pair(sums, n))
    for i in range(4):
        for j in range(4):
            true = sum(Fraction(n * int(r[i]) - sums[i], n) * Fraction(n * int(r[j]) - sums[j], n) for r in x)
            got = Fraction(float(high[i, j])) + Fraction(float(low[i, j]))
            assert abs(got - true) <= abs(true) * Fraction(1, 10**25) + Fraction(1, 10**22)


def test_products_and_sums_lose_nothing():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50) * 10.0 ** rng.integers(-8, 8, 50), rng.normal(size=50)
    for f, g in ((w.two_sum, lambda p, q: p + q), (w.two_product, lambda p, q: p * q)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(e) == g(Fraction(p), Fraction(q)) for h, e, p, q in zip(high, low, a, b))


def test_small_components_beside_a_large_one():
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(5, 5)))[0].astype(np.longdouble)
    for _ in range(2):
        basis = basis + basis @ (np.eye(5) - basis.T @ basis) / 2
    values = np.array([1e13, 50, 3, 1, 1e-3], np.longdouble)
    v = (basis * values) @ basis.T
    high = v.astype(np.float64)
    got, vectors, trace = w.components((high, (v - high).astype(np.float64)), 1)
    assert np.allclose((got / values).astype(float), 1, rtol=1e-4)
    assert np.abs(np.abs((vectors.T @ basis).astype(float)) - np.eye(5)).max() < 1e-6


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (2, [3.0, 1.0], 0), (None, [0.5, 0.25], None), (4, None, 1), (5, [1.0, None], 1),
            (6, [nan, 1.0], 1), (7, [1.0, inf], 1), (8, [-inf, 1.0], 1)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "2", "2", "None"] and {r["n"] for r in got} == {4}
    assert {len(r["components"]) for r in got} == {2} and {r["label"] for r in got} == {0, None}
    white, _, deviation = brute([[1, 2], [3, 1], [3, 1], [0.5, 0.25]])
    assert sorted(r["deviation"] for r in got) == sorted(deviation)
    ours = sorted(abs(r["components"][0]["whitened"]) for r in got)
    assert np.allclose(ours, sorted(np.abs(white[:, 0])))


def test_without_variance_or_rows(spark):
    same = w.whiten(spark.createDataFrame([(k, [1.0, k % 2.0, 2.0], 0) for k in range(4)], SCHEMA)).collect()
    assert [c["whitened"] is None for c in same[0]["components"]] == [False, True, True]
    assert [c["explained"] for c in same[0]["components"]] == [1.0, 0.0, 0.0] and same[0]["identity_error"] < 1e-12
    flat = w.whiten(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(3)], SCHEMA)).collect()
    assert all(c["whitened"] is None for r in flat for c in r["components"]) and {r["identity_error"] for r in flat} == {0.0}
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        df = w.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.selectExpr("inline(components)").count() == 0
    one = w.whiten(spark.createDataFrame([(1, [1.5], 0)], SCHEMA)).collect()
    assert one[0]["components"][0]["whitened"] is None and one[0]["deviation"] == 0


def test_names_that_clash_and_large_values(spark):
    rows = [(k, [float(k), 1.0], k) for k in range(4)]
    df = spark.createDataFrame(rows, "n long, embedding array<double>, _x int")
    got = w.whiten(df)
    assert "_x" in got.columns and {r["n"] for r in got.collect()} == {4}
    far = [(1, [4e12], 0), (2, [-4e12], 0)]
    with pytest.raises(Exception, match="fit a long"):
        w.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect()
    with pytest.raises(Exception, match="too large"):
        w.whiten(spark.createDataFrame([(1, [1e18], 0)], SCHEMA)).collect()
    with pytest.raises(Exception, match="different lengths"):
        w.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert isinstance(got.schema["identity_error"].dataType, T.DoubleType)
