"""Sentence vectors made once a row, the store of mapped vectors, bounded vocabularies and bags inside rows."""

import numpy as np
import pytest
from textloom import plans
from textloom.operators import embedding as E
from textloom.operators import features as X
from textloom.operators import semantic as Q
from textloom.operators import vocabulary as V
from textloom.sources import vector_store as S

from tests.oracle import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e04_sentence_vectors", "e04_mapped_vectors", "q03_semantic_topk", "q05_batch", "q07_multi_query", "q13_unit_words", "p07_exclude_regex"])
def test_vectors_are_made_once_a_row(spark, name):
    text = plan(plans.QUERIES[name](spark, DATA))
    assert text.count("ArrowEvalPython") == 1, text


def test_least_length_is_tested_before_vectors_are_made(spark):
    text = plan(plans.QUERIES["q03_semantic_topk"](spark, DATA))
    assert ">= 15" in text[text.index("ArrowEvalPython") :]


def toy(spark, n=500, dim=7, kind="float", seed=1):
    rng = np.random.default_rng(seed)
    table = rng.normal(size=(n, dim)).astype(np.float32)
    return table, spark.createDataFrame([(f"w{k}", [float(x) for x in v]) for k, v in enumerate(table)], f"word string, vector array<{kind}>")


@pytest.mark.parametrize(("kind", "shard_bytes"), [("float", 1 << 20), ("float", 700), ("double", 900)])
def test_store_finds_every_word(spark, kind, shard_bytes):
    table, vectors = toy(spark, kind=kind)
    store = S.store_vectors(vectors.repartition(5), shard_bytes=shard_bytes)
    assert store.words == 500 and store.dim == 7 and store.kind == {"float": "f4", "double": "f8"}[kind]
    assert store.shards == -(-500 * 7 * (4 if kind == "float" else 8) // shard_bytes)
    asked = ["w3", "unknown", "", "w499", "w0", "é"]
    places, found = store.find(asked)
    assert [p >= 0 for p in places] == [True, False, False, True, True, False]
    for word, place in zip(asked, places):
        if place >= 0:
            assert (found[place] == table[int(word[1:])]).all()
    assert store.find([])[0].shape == (0,)


def test_store_of_odd_rows(spark):
    rows = [("a", [1.0, 2.0]), ("a", [1.0, 1.0]), ("a", [1.0, 2.0]), (None, [1.0, 1.0]), ("b", None), ("c", [0.0, 0.0])]
    store = S.store_vectors(spark.createDataFrame(rows, "word string, vector array<double>"), shard_bytes=1)
    places, found = store.find(["a", "b", "c"])
    assert store.words == 2 and found[places[0]].tolist() == [1.0, 1.0] and places[1] == -1
    none = S.store_vectors(spark.createDataFrame([], "word string, vector array<double>"))
    rows = spark.createDataFrame([(1, ["a"]), (2, None)], "k int, words array<string>")
    assert none.words == 0 and [r["vector"] for r in E.sentence_vectors(rows, none).collect()] == [None, None]


def test_mapped_vectors_equal_joined_ones_without_a_shuffle(spark):
    table, vectors = toy(spark, n=3000, dim=5)
    rng = np.random.default_rng(2)
    rows = [(k, [f"w{int(x)}" for x in rng.integers(0, 3500, rng.integers(0, 12))]) for k in range(300)] + [(-1, None), (-2, ["w1", "w1", "w2"])]
    df = spark.createDataFrame(rows, "k int, words array<string>")
    # The matrix takes 3000 * (8 * 5 + 100) bytes: over this limit the vectors are mapped.
    got = E.sentence_vectors(df, vectors, limit_bytes=100_000)
    text = plan(got)
    assert "Exchange" not in text and "Join" not in text and text.count("ArrowEvalPython") == 1
    ours = {r["k"]: r["vector"] for r in got.collect()}
    joined = {r["k"]: r["vector"] for r in E.sentence_vectors(df, vectors, method="join").collect()}
    for k, words in rows:
        known = [table[int(w[1:])].astype(float) for w in words or [] if int(w[1:]) < 3000]
        if not known:
            assert ours[k] is None and joined[k] is None
            continue
        total = np.sum(known, axis=0)
        assert np.allclose(ours[k], total / np.linalg.norm(total)) and np.allclose(joined[k], ours[k])


def test_shards_that_cannot_be_mapped_are_held_within_a_bound(spark, monkeypatch):
    _, vectors = toy(spark)
    store = S.store_vectors(vectors, shard_bytes=700)
    monkeypatch.setattr(S.fs, "LocalFileSystem", type(None))
    monkeypatch.setattr(S, "HELD_BYTES", 3000)
    S._held.clear()
    assert (store.find([f"w{k}" for k in range(500)])[0] >= 0).all()
    assert len(S._held) < store.shards and sum(map(S._weight, S._held.values())) <= 3000
    S._held.clear()


def test_first_words_are_the_vocabulary_s_first(spark, monkeypatch):
    words = [["b"] * 3, ["a", "c", "d", "a"], ["e", "c"], None]
    df = spark.createDataFrame([(w,) for w in words], "words array<string>")
    want = [("b", 1, 3), ("a", 2, 2), ("c", 3, 2), ("d", 4, 1)]
    assert sorted(map(tuple, V.first_words(df, 4).collect()), key=lambda r: r[1]) == want
    monkeypatch.setattr(V, "BOUNDED", 1)
    assert sorted(map(tuple, V.first_words(df, 4).collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("most", [V.BROADCAST_BYTES, 0])
def test_known_words_in_the_row_and_by_join(spark, most):
    rows = [(1, ["a", "x", "b", "a"], "p"), (2, ["x"], "q"), (3, [], "r"), (4, None, "s"), (1, ["b"], "t")]
    df = spark.createDataFrame(rows, "post_id int, words array<string>, other string")
    vocabulary = spark.createDataFrame([("a", 1, 5), ("b", 2, 3)], "word string, word_id long, cnt long")
    got = V.known_words(df, vocabulary, most=most)
    assert sorted((r["post_id"], r["words"], r["other"]) for r in got.collect()) == [(1, ["a", "b", "a"], "p"), (1, ["b"], "t")]
    if most:
        assert plan(got).count("ArrowEvalPython") == 1 and "Exchange" not in plan(got)


def test_tables_are_weighed_by_bytes(spark):
    _, vectors = toy(spark, n=100, dim=50, kind="double")
    assert 100 * 50 * 8 <= V.table_bytes(vectors) <= 100 * (50 * 8 + 200)
    rows = spark.createDataFrame([("w1", 1), ("w1", 2), ("zz", 3)], "word string, k int")
    for most in (V.BROADCAST_BYTES, 10):
        joined = V.join_words(rows, vectors, "left", most)
        assert sorted((r["k"], r["vector"] is None) for r in joined.collect()) == [(1, False), (2, False), (3, True)]


def test_bags_inside_rows(spark):
    rows = [(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["z"] * 1000)]
    df = spark.createDataFrame(rows[:0] + [(k, [x for x in w if x] if w is not None else None) for k, w in rows], "k int, words array<string>")
    got = X.bag_of_words(df, ["k"], one_row=True)
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, X.bag_of_words(df, ["k"]).collect())) == [(1, "a", 1), (1, "b", 2), (4, "z", 1000)]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    table = np.round(rng.normal(size=(230, 4)), 1)
    table[7] = 0
    table[50:60] = table[50]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)] + [(999, None)], "id long, vector array<double>").repartition(3)
    got = Q.nearest(rows.filter("id % 10 = 0"), rows, 5, "id", block=16)
    units = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 230, 10):
        scores = np.round(units @ units[q], 6)
        order = sorted((k for k in range(230) if k != 7), key=lambda k: (-scores[k], k))[:5]
        want += [(q, k, r + 1) for r, k in enumerate(order)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
