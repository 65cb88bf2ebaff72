"""The inverted index against the scan: same hits, fewer blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from textloom.operators import keyword as K
from textloom.operators import postings as P

SCHEMA = "post_id long, ptext string, user string"


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["word", "wording", "worry", "time", "year", "élan"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab[: rng.choice([3, 10, 46])]) for _ in range(rng.choice([0, 1, 5, 30]))]
        rows.append((rng.choice([k, -k - 1, k * 10**12]), " ".join(words) if words else rng.choice([None, "", "the of"]), rng.choice(["src1", "src2 x", None])))
    return K.analysed(spark.createDataFrame({r[0]: r for r in rows}.values(), SCHEMA).repartition(4))


QUERIES = [
    [K.part("time")], [K.part("w0")], [K.part("w0"), K.part("w1"), K.part("w45x")], [K.part("w0"), K.part("w0")], [K.part("time year")], [K.part("w0 w0")],
    [K.part("wor", prefix=True)], [K.part("w", prefix=True), K.part("time")], [K.part("wor", "must", prefix=True), K.part("time", "not")],
    [K.part("src1", field="user"), K.part("w2")], [K.part("the", "must"), K.part("w1", "must"), K.part("w2")], [K.part("w1", "must"), K.part("w2", "must"), K.part("w0", "not")],
    [K.part("w0", "not")], [], [K.part("absent")], [K.part("élan")], [K.part("w0 w1", "must"), K.part("w1 w0")],
]


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_index_gives_what_the_scan_gives(spark, k):
    posts = corpus(spark)
    index = P.build_index(posts)
    assert P.open_index(spark, index.folder) == index
    got = P.search_index(index, spark, QUERIES, k)
    want = K.search_batch(posts, QUERIES, k).select("query_id", "post_id", "score", "rank")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["post_id"], r["score"]) for r in df.collect())
    ours, theirs = rows(got), rows(want)
    assert len(ours) == len(theirs) and len(theirs) > 10 * min(k, 2)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 1.1e-6


def test_only_the_buckets_of_the_words_are_opened(spark):
    index = P.build_index(corpus(spark, 3000), buckets=6)
    blocks = index.blocks(spark)
    assert blocks.select("bucket").distinct().count() > 1
    asked = {0: [K.part("time")]}
    plan = P.plan_search(index, spark, asked, 5).blocks._jdf.queryExecution().executedPlan().toString()
    opened = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "bucket" in opened
    read = P._wanted(index, spark, {K.part("time"): 0}).select("bucket").distinct().count()
    assert 1 <= read < blocks.select("bucket").distinct().count()


def test_blocks_that_cannot_reach_the_best_are_left_out(spark):
    # Short posts come first: later blocks have long posts only, of which none is among the best.
    rows = [(k, "time " + "pad " * (0 if k < 300 else 400), "u") for k in range(4000)]
    posts = K.analysed(spark.createDataFrame(rows, SCHEMA))
    index = P.build_index(posts)
    queries = {0: [K.part("time")]}
    search = P.plan_search(index, spark, queries, 3)
    total = search.blocks.count()
    kept = search.blocks.filter(F.col("top") >= search.least[0] * (1 - 1e-12)).count()
    assert total >= 4000 // P.BLOCK and 1 <= kept <= total // 4
    got = P.search_index(index, spark, [queries[0]], 3).orderBy("rank").collect()
    assert [r["post_id"] for r in got] == [0, 1, 2]


def test_packing_is_reversible():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 1 << 16, 1 << 40):
        values = rng.integers(0, top, 50)
        values[20:30] = 1
        packed = P.pack(values.astype(np.uint64), np.array([0, 20, 30]))
        assert [P.unpack(x).tolist() for x in packed] == [values[:20].tolist(), [1] * 10, values[30:].tolist()]
        assert len(packed[1].as_py()) == 11
    posts = np.sort(np.array([-(2**62), -5, 0, 3, 2**62, 2**63 - 1]))
    lists = [[0], [4, 9], [7], [1, 2, 3], [300], [0, 70000]]
    flat = pa.RecordBatch.from_pydict({
        "field": ["ptext"] * 6, "term": ["a"] * 6, "post": pa.array(posts, pa.int64()), "tf": pa.array([len(x) for x in lists], pa.int32()),
        "length": pa.array([80000] * 6, pa.int32()), "places": pa.array(lists, pa.list_(pa.int32())),
    })
    block = P._blocks(flat)
    ids, tf, length, offsets, places = P.decode(posts[0], *(block.column(c)[0] for c in ("steps", "tfs", "lengths", "places")))
    assert ids.tolist() == posts.tolist() and [places[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == lists
    assert tf.tolist() == [1, 2, 1, 3, 1, 2] and set(length.tolist()) == {80000}


def test_empty_corpus_and_null_keys(spark):
    posts = K.analysed(spark.createDataFrame([], SCHEMA))
    index = P.build_index(posts)
    assert P.search_index(index, spark, QUERIES, 5).count() == 0
    one = P.build_index(K.analysed(spark.createDataFrame([(None, "time", None), (4, "time", None)], SCHEMA)))
    assert [r["post_id"] for r in P.search_index(one, spark, [[K.part("time")]], 5).collect()] == [4]
