"""Tasks keep only their own best rows: few rows are shuffled, and they are those that a sort of all rows gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.operators import semantic as Q


def shuffled(df) -> int:
    """Rows that df's run writes to shuffles."""
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (found.get().value() if found.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def many(spark):
    """4,000 sentences in four tasks, scores mostly distinct; a word for each place on a circle."""
    angles = np.linspace(0, np.pi, 1000)
    vectors = spark.createDataFrame([(f"w{i}", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "word string, vector array<double>")
    rows = spark.range(4000, numPartitions=4).select(
        F.col("id").alias("post_id"), F.lit(0).cast("long").alias("sent"),
        F.array(F.concat(F.lit("w"), (F.col("id") * 7919 % 1000).cast("string")), F.concat(F.lit("w"), (F.col("id") * 104729 % 997).cast("string"))).alias("words"),
    )
    return rows.withColumn("n_words", F.size("words").cast("long")), vectors


def test_few_rows_of_a_search_are_shuffled(many):
    rows, vectors = many
    hits = Q.search(rows, vectors, ["w0", "w500"], k=5, min_words=0)
    assert hits.count() == 10
    assert 10 <= shuffled(hits) <= 200  # of 8,000 that are scored


def brute(rows, k, dedupe, offset):
    """As the docstring of top_scores says it."""
    out = {}
    for query in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == query and (dedupe == "pre" or r[4])), key=lambda r: (-r[1], r[2], r[3]))
        first = {}
        for r in own:
            first.setdefault(r[1], r)
        out[query] = [r[2:4] for r in first.values() if r[4]][offset : offset + k]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("dedupe", ["post", "pre"])
@pytest.mark.parametrize("offset", [0, 4])
@pytest.mark.parametrize("depth", [1, 500])
def test_best_rows_are_those_of_all_rows(spark, monkeypatch, dedupe, offset, depth):
    monkeypatch.setattr(Q, "DEPTH", depth)
    rng = random.Random(5)
    # Three queries with many equal scores; few of the best rows of the last one pass.
    rows = [(q, rng.randrange(-60, 60) / 100, rng.randrange(400), rng.choice(["a", "b", "é", "z"]), False) for q in (0, 1, 2) for _ in range(1500)]
    rows = [(q, s, i, w, rng.random() < (0.5, 0.9, 0.02 if s > 0 else 0.3)[q]) for q, s, i, w, _ in {r[:4]: r for r in rows}.values()]
    table = spark.createDataFrame([(*r, 1) for r in rows], "query_id long, score double, a long, b string, good boolean, n_words int").repartition(7)
    got: dict = {}
    for r in sorted(Q.top_scores(table, 6, ["a", "b"], keep=F.col("good"), dedupe=dedupe, offset=offset).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["a"], r["b"]))
    assert got == brute(rows, 6, dedupe, offset)


def test_all_rows_are_shuffled_where_a_task_would_hold_too_many(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD_ROWS", 10)
    rows = spark.range(300, numPartitions=3).select("id", F.lit(0).alias("query_id"), (F.col("id") / 1000).alias("score"), F.lit(1).alias("n_words"))
    got = Q.top_scores(rows, 3, ["id"], keep=F.col("id") < 4, dedupe="pre").orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 2, 1]


def test_scores_are_rounded_as_spark_does(spark):
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.uniform(-2, 2, 300), rng.integers(-2_000_000, 2_000_000, 2_000) / 1e6 + 5e-7, [0.0, -0.0, -1e-9, 5e-7, -5e-7, 1.0000005, 2e9 + 0.1234565, 1e30, np.inf]])
    frame = spark.createDataFrame([(float(x),) for x in scores], "x double").select("x", F.round("x", Q.DIGITS).alias("r")).collect()
    assert [r["r"] for r in frame] == Q.rounded(np.array([r["x"] for r in frame])).tolist()


def test_null_scores_come_last_and_no_numbers_first(spark):
    rows = [(1, None), (2, 0.5), (3, float("nan")), (4, None), (5, 0.1)]
    table = spark.createDataFrame([(0, i, s, 1) for i, s in rows], "query_id long, id long, score double, n_words int").repartition(3)
    assert [r["id"] for r in Q.top_scores(table, 9, ["id"]).orderBy("rank").collect()] == [3, 2, 5, 1]
