"""Thousands of searches at once give what they give one by one."""

import random

import pytest
from textloom.operators import keyword as K
from textloom.operators import saved_searches as S

from tests.test_postings import QUERIES, corpus


def rows(df):
    return sorted((r["query_id"], r["rank"], r["post_id"], r["score"]) for r in df.collect())


def test_batches_give_what_the_scan_gives(spark):
    posts = corpus(spark)
    ours = rows(S.search_many(posts, QUERIES, 7))
    theirs = rows(K.search_batch(posts, QUERIES, 7).select("query_id", "post_id", "score", "rank"))
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 1.1e-6


def test_two_thousand_searches(spark):
    posts = corpus(spark, 300)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["time", "year", "absent"]

    def one():
        return [K.part(" ".join(rng.choices(words, k=rng.choice([1, 1, 2]))), rng.choice(["may", "may", "must", "not"]), prefix=False) for _ in range(rng.randint(1, 3))]

    queries = [one() for _ in range(2000)]
    ours = rows(S.search_many(posts, queries, 3))
    picked = rng.sample(range(2000), 25)
    theirs = rows(K.search_batch(posts, [queries[i] for i in picked], 3).select("query_id", "post_id", "score", "rank"))
    place = {q: i for i, q in enumerate(picked)}
    some = sorted((place[q], *rest) for q, *rest in ours if q in place)
    assert [x[:3] for x in some] == [x[:3] for x in theirs] and len({q for q, *_ in ours}) > 1000


def test_overlapping_phrases_and_prefixes(spark):
    posts = K.analysed(spark.createDataFrame([(1, "x x x y"), (2, "xy xyz x"), (3, None)], "post_id long, ptext string"))
    found = S.search_many(posts, [[K.part("x x")], [K.part("x", prefix=True)], [K.part("xy", prefix=True)], [K.part("x y")], [K.part("x x x y")]], 5)
    assert sorted((r["query_id"], r["post_id"]) for r in found.collect()) == [(0, 1), (1, 1), (1, 2), (2, 2), (3, 1), (4, 1)]


def test_searches_are_weighed_and_may_be_none(spark):
    posts = corpus(spark, 20)
    with pytest.raises(ValueError, match="several batches"):
        S.search_many(posts, QUERIES, max_bytes=100)
    assert S.search_many(posts, [[], [K.part("w0", "not")]]).count() == 0
    assert S.search_many(posts.limit(0), QUERIES).count() == 0
