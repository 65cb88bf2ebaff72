"""Semantic and keyword search, weights and metrics on hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F
from textloom.operators import embedding as E
from textloom.operators import keyword as K
from textloom.operators import metrics as MX
from textloom.operators import semantic as Q
from textloom.operators import weighting as W


@pytest.fixture(scope="module")
def toy(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0])], "word string, vector array<double>")
    rows = spark.createDataFrame([(1, 0, ["a", "a", "b"]), (2, 0, ["b"]), (3, 0, ["c"]), (4, 0, [])], "post_id long, sent long, words array<string>")
    rows = rows.withColumn("n_words", F.size("words"))
    return E.sentence_vectors(rows, vectors), vectors


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("a", {1: 0.894427, 2: 0.0}),
        ("a [2] b", {1: 1.0, 2: 0.447214}),
        (("a", "b"), {1: 0.948683, 2: 0.707107}),
        ("[9] A", {1: 0.894427, 2: 0.0}),
        ("unknown c", {}),
    ],
)
@pytest.mark.parametrize("method", ["batch", "columns"])
def test_scores(toy, query, expected, method):
    rows, vectors = toy
    got = Q.search(rows, vectors, [query], min_words=0, method=method).collect()
    assert {r["post_id"]: r["score"] for r in got} == expected


def test_both_ways_to_make_sentence_vectors_agree(spark, toy):
    rows, vectors = toy
    joined = E.sentence_vectors(rows.drop("vector"), vectors, method="join")
    a, b = ({r["post_id"]: r["vector"] for r in x.collect()} for x in (rows, joined))
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert (v is None) == (b[k] is None)
        assert v is None or v == pytest.approx(b[k])
    with pytest.raises(ValueError, match="bytes"):
        E.sentence_vectors(rows.drop("vector"), vectors, method="batch", limit_bytes=10)


def test_sum_over_queries(toy):
    rows, vectors = toy
    got = Q.multi_query(rows, vectors, ["a", "b"]).orderBy("rank").collect()
    assert [(r["post_id"], r["score"]) for r in got] == [(1, 1.341641), (2, 1.0), (3, 0.0)]  # equal scores count once
    every = Q.multi_query(rows, vectors, ["a", "b"], dedupe=None).orderBy("rank").collect()
    assert [(r["post_id"], r["score"]) for r in every] == [(1, 1.341641), (2, 1.0), (3, 0.0), (4, 0.0)]
    words_only = Q.multi_query(rows.drop("vector"), vectors, ["a", "b"], ignore=1).orderBy("rank").collect()
    assert [(r["post_id"], r["score"]) for r in words_only] == [(2, 1.0), (3, 0.0)]
    assert [r["post_id"] for r in Q.multi_query(rows, vectors, ["a", "b"], ignore=1, k=2).orderBy("rank").collect()] == [2, 3]


def test_parse_query():
    assert Q.parse_query("i feel Fantastic [10]") == [("i", 1.0), ("feel", 1.0), ("fantastic", 10.0)]
    assert Q.parse_query("family [5] holiday [-1] ") == [("family", 5.0), ("holiday", -1.0)]
    assert Q.parse_query("[2] the") == [("the", 1.0)]
    assert Q.parse_query("") == []


def test_query_without_known_words_warns(toy):
    rows, vectors = toy
    with pytest.warns(UserWarning, match=r"\[0\]"):
        assert Q.search(rows, vectors, ["nothing"], min_words=0).count() == 0


def test_dedupe_before_or_after_the_tests(spark):
    rows = spark.createDataFrame([(1, 5, 0.5), (2, 20, 0.5), (3, 20, 0.4), (4, 20, 0.4)], "post_id long, n_words int, score double").withColumn("query_id", F.lit(0))
    got = lambda d: [r["post_id"] for r in Q.top_scores(rows, 9, ["post_id"], min_words=15, dedupe=d).orderBy("rank").collect()]
    assert (got("post"), got("pre"), got(None)) == ([2, 3], [3], [2, 3, 4])


def test_fewer_results_are_a_prefix_of_more(toy):
    rows, vectors = toy
    many = [r["post_id"] for r in Q.search(rows, vectors, ["a [2] b"], k=3, min_words=0).orderBy("rank").collect()]
    assert [r["post_id"] for r in Q.search(rows, vectors, ["a [4] b [2]"], k=1, min_words=0).collect()] == many[:1]


def test_tfidf(spark):
    bow = spark.createDataFrame([(1, "w", 1), (2, "w", 1), (2, "v", 3), (9, "new", 4)], "post_id long, word string, cnt long")
    idf = W.inverse_frequency(bow.filter("post_id < 9"), 2)
    got = {(r["post_id"], r["word"]): r["weight"] for r in W.tfidf(bow, idf).collect()}
    assert got[2, "v"] == pytest.approx(3 * math.log(2))
    assert (got[1, "w"], got[9, "new"]) == (0.0, 0.0)


@pytest.mark.parametrize("digits", [1, 3])
def test_split_is_exact_in_each_group(spark, digits):
    rows = spark.range(1010).select("id", F.when(F.col("id") < 10, "small").when(F.col("id") < 1000, "hot").alias("g"))
    got = {r["g"]: (r["n"], r["t"]) for r in W.split(rows, 0.25, "g", "id", digits).groupBy("g").agg(F.count("*").alias("n"), F.count_if("test").alias("t")).collect()}
    assert got == {"small": (10, 3), "hot": (990, 248), None: (10, 3)}


def test_auc(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    assert MX.auc(rows).first()["auc"] == 0.75
    assert MX.auc(rows.withColumn("score", F.lit(0.5))).first()["auc"] == 0.5
    assert MX.auc(rows.filter("label = 1")).first()["auc"] is None


POSTS = [
    (1, "The red fox jumps over a lazy dog", "ann", 5),
    (2, "A lazy red dog sleeps", "bob", -1),
    (3, "Foxes and dogs: red, red, red!", "ann", 7),
    (4, "", "cat", None),
    (5, None, None, 5),
]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ([K.part("fox")], {1}),
        ([K.part("fox", prefix=True)], {1, 3}),
        ([K.part("lazy dog")], {1}),
        ([K.part("lazy red dog")], {2}),
        ([K.part("red"), K.part("lazy", "not")], {3}),
        ([K.part("red", "must"), K.part("dog", "must")], {1, 2}),
        ([K.part("fox"), K.part("sleeps")], {1, 2}),
        ([K.part("red"), K.part("fox", "not")], {2, 3}),
        ([K.part("ann", field="user")], {1, 3}),
        ([K.part("ann", "must", "user"), K.part("fox", "must", prefix=True)], {1, 3}),
        ([K.part("7", field="mood")], {3}),
        ([K.part("red", "not")], set()),
        ([K.part("the")], set()),
        ([], set()),
    ],
)
def test_keyword_search(spark, query, expected):
    posts = K.analysed(spark.createDataFrame(POSTS, "post_id long, ptext string, user string, mood int"))
    assert {r["post_id"] for r in K.search(posts, query).collect()} == expected


def test_keyword_ranking_and_report(spark):
    posts = K.analysed(spark.createDataFrame(POSTS, "post_id long, ptext string, user string, mood int"))
    hits = K.search(posts, [K.part("red")], k=2)
    assert [r["post_id"] for r in hits.orderBy("rank").collect()] == [3, 2]
    names = spark.createDataFrame([(7, "calm")], "mood_id int, mood string")
    assert {r["post_id"]: r["mood_name"] for r in K.report(hits, names).collect()} == {3: "calm", 2: "N/A"}
    with pytest.raises(ValueError, match="unknown field"):
        K.search(posts, [K.part("red", field="color")])
