import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import ngram_lm as N
from textloom.llm.elias_fano import EliasFano
from textloom.llm.queries import op1_ngram_lm


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200), st.integers(0, 1 << 41))
def test_elias_fano(values, x):
    values = sorted(values)
    ef = EliasFano.build(np.array(values, np.uint64), (values[-1] if values else 0) + 1)
    n = len(values)
    assert ef.access(np.arange(n)).tolist() == values
    for lo, hi in ((0, n), (n // 3, n // 2)):
        want = next((i for i in range(lo, hi) if values[i] >= x), hi)
        assert ef.successor(np.array([x]), np.array([lo]), np.array([hi])).tolist() == [want]


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [None]


def test_token_hashes_are_of_words():
    texts = ["a b", "", None, "B\tA a", "  ", "é É ab", "xa", "a", "x" * 5000, " b", "b "]
    distinct, codes, lengths = N.tokens(pa.array(texts))
    hashes = distinct[codes]
    flat = [w for t in texts for w in words(t)]
    assert lengths.tolist() == [len(words(t)) for t in texts]
    of = {}
    for w, h in zip(flat, hashes.tolist()):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    distinct, codes, _ = N.tokens(pa.array(texts).slice(3, 2))
    assert distinct[codes].tolist() == hashes[5:10].tolist()


@pytest.mark.parametrize("length", [1 << 10, 1 << 11, 1 << 12])
def test_words_that_polynomial_hashes_mix_up(length):
    first = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
    other = first.translate(str.maketrans("ab", "ba"))
    assert len(N.tokens(pa.array([f"{first} {other}"]))[0]) == 3


def test_hot_contexts_are_spread(spark):
    """One word stands before every other: its n-grams cross several shards and are all found."""
    texts = [" ".join(f"the w{k}" for k in range(i * 40, i * 40 + 40)) for i in range(20)]
    trie = N.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), order=3, mass=2.0, tokens_per_shard=160)
    bounds = trie.index(2)["bounds"].tolist()
    assert len(bounds) > len(set(bounds))
    model = Plain(texts, 3, 2.0)
    for r in N.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trie).collect():
        w = words(texts[r.doc_id])
        assert abs(r.score - sum(math.log10(model.prob(w, i)) for i in range(len(w)))) < 1e-3 * len(w)


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order, mass):
        self.order, self.mass, self.counts, self.contexts = order, mass, Counter(), Counter()
        for t in texts:
            w = words(t)
            for i in range(len(w)):
                for k in range(1, order + 1):
                    gram = self.gram(w, i, k)
                    if gram:
                        self.counts[gram] += 1
        self.tokens = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.vocabulary = sum(len(g) == 1 for g in self.counts)

    @staticmethod
    def gram(w, i, k):
        return tuple([None, *w][i - k + 2 : i + 2]) if k == 1 or i - k + 2 >= 0 else None

    def prob(self, w, i):
        p = (self.counts[(w[i],)] + 1) / (self.tokens + self.vocabulary + 1)
        for k in range(2, self.order + 1):
            gram = self.gram(w, i, k)
            if gram:
                total = self.counts[gram[:-1]] if len(gram) > 1 else 0
                p = (self.counts[gram] + self.mass * p) / (total + self.mass)
        return p


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_dictionaries(spark, order):
    texts = ["the cat sat on the mat", "The cat ran", None, "", "a b a b a b c", "é é cat sat", "the cat sat on the mat"] * 3
    df = spark.createDataFrame([(i, t, "?", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, n_known string, score double")
    trie = N.train(df.select("text").repartition(4), order=order, mass=2.0, tokens_per_shard=20, docs_per_word_shard=5)
    model = Plain(texts, order, 2.0)
    assert (trie.tokens, trie.words) == (model.tokens, model.vocabulary)
    more = texts + ["unseen words the cat", "b a b z", " mat the on "]
    rows = spark.createDataFrame(list(enumerate(more)) + [(None, "cat")], "doc_id long, text string")
    got = N.score(rows, trie).collect()
    assert len(got) == len(more) + 1
    for r in got:
        w = words("cat" if r.doc_id is None else more[r.doc_id])
        assert r.n_tokens == len(w) and r.n_known == sum(model.counts[(x,)] > 0 for x in w)
        base = sum(math.log10((model.counts[(x,)] + 1) / (model.tokens + model.vocabulary + 1)) for x in w)
        assert abs(r.base_score - base) < 1e-9
        assert abs(r.score - sum(math.log10(model.prob(w, i)) for i in range(len(w)))) < 1e-3 * len(w)
    assert N.score(rows.limit(0), trie).count() == 0
    empty = N.train(df.limit(0).select("text"), order=order)
    assert [r.n_known for r in N.score(rows, empty).collect()] == [0] * (len(more) + 1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    model = Plain([t for i, t in docs.items() if not held[i]], 3, 1000.0)
    got = op1_ngram_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = words(docs[r.doc_id])
        base = sum(math.log10((model.counts[(x,)] + 1) / (model.tokens + model.vocabulary + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(w), model.tokens)
        assert abs(r.base_score - base) < 1e-6 and r.n_known == sum(model.counts[(x,)] > 0 for x in w)
        assert abs(r.score - sum(math.log10(model.prob(w, i)) for i in range(len(w)))) < 1e-3 * len(w)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_order_four_smooths_with_trigrams(spark):
    texts = ["the cat sat on the mat", "a cat sat on a mat", "the cat sat on it", "the dog sat on the mat", "dog cat sat by the mat"]
    trie = N.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order=4, mass=2.0, tokens_per_shard=10)
    model = Plain(texts, 4, 2.0)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in N.score(rows, trie).collect():
        w = words(texts[r.doc_id])
        assert abs(r.score - sum(math.log10(model.prob(w, i)) for i in range(len(w)))) < 1e-3 * len(w)
