import zlib

import numpy as np
import pyarrow as pa

from textloom.llm import quality_model as Q
from textloom.llm.queries import op7_quality_model

SCHEMA = "doc_id long, text string, score string, y int"


def auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op7_quality_model(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    kept = [got[i].predicted for i, y in labels.items() if y == 1 and got[i].held_out]
    print("auc", auc(held), "kept", sum(kept) / len(kept))
    assert auc(held) > 0.9 and sum(kept) / len(kept) > 0.95


def test_nulls_repeats_and_no_labels(spark):
    rows = [(1, None, "?", 0), (1, "", "?", 0), (None, "a b", "?", 1), (2, "x" * 50000, "?", 1), (2, "good words " * 9, "?", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = df.select("doc_id", "y").limit(0)
    for labels in (none, df.select("doc_id", "y")):
        got = Q.score(df, Q.fit(df, labels, label="y")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.score(df.limit(0), Q.fit(df, none, label="y")).count() == 0


def plain_sums(texts):
    index, sums = Q.index_vectors(Q.BUCKETS, Q.DIM, 1), {}
    for t in texts:
        rows = [zlib.crc32(w.lower()) % Q.BUCKETS for w in (t or "").encode().split()]
        for i, r in enumerate(rows):
            for j in (*range(max(i - Q.WINDOW, 0), i), *range(i + 1, min(i + Q.WINDOW + 1, len(rows)))):
                sums[r] = sums.get(r, 0) + index[rows[j]].astype(np.int64)
    return sums


def test_word_vectors_cover_all_documents(spark, monkeypatch):
    texts = [None, "", "one", "A b", "the cat sat on the mat and the cat ran", "x y " * 300, " é\tÉ é\n q " * 7] * 3
    want = plain_sums(texts)
    monkeypatch.setattr(Q, "SLICE", 50)
    sums = np.zeros((Q.BUCKETS, Q.DIM), np.int32)
    Q._context_sums(pa.array(texts), sums, Q.index_vectors(Q.BUCKETS, Q.DIM, 1).astype(np.int8))
    assert all((sums[r] == v).all() for r, v in want.items()) and np.count_nonzero(sums.any(1)) <= len(want)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b = (Q.word_vectors(df.repartition(n), "text") for n in (1, 5))
    monkeypatch.setattr(Q, "adding_salts", lambda tasks: 3)
    c = Q.word_vectors(df.repartition(6), "text")
    assert (a == b).all() and (a == c).all() and a.dtype == np.float16
    row, v = max(want.items(), key=lambda r: np.linalg.norm(r[1]))
    own = Q.index_vectors(Q.BUCKETS, Q.DIM, 1)[row] / np.sqrt(Q.NONZERO)
    assert np.allclose(a[row], v / np.linalg.norm(v) + own, atol=2e-3)


def test_ids_of_text_and_repeated_labelled_ids(spark):
    """5,000 rows of one labelled id are learnt from once a label."""
    rows = [("hot", f"good text {k}") for k in range(5000)] + [(f"d{k}", f"bad !!! {k} ###") for k in range(40)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([("hot", 1), ("hot", 1), *((f"d{k}", k % 2) for k in range(40)), (None, 1)], "doc_id string, y int")
    model = Q.fit(df, labels, label="y")
    assert Q.score(df, model).count() == len(rows)
    assert abs(model.prior - 22 / 42) < 1e-9


def test_features_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float16)
    shapes = Q.index_vectors(Q.SHAPES, Q.SHAPE_DIM, 2)
    shape_of = lambda w: bytes(ord("a") if 97 <= b <= 122 or b > 127 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in w)
    texts = ["The cat, the CAT 12\nThe cat, the CAT 12", "", "é!", "a " * 500 + "b"]
    got = Q.features(texts, vectors)
    for row, text in zip(got, texts):
        words = text.encode().split()
        if not words:
            assert not row.any()
            continue
        word, shape = np.zeros(Q.DIM), np.zeros(Q.SHAPE_DIM)
        for w in words:
            word += vectors[zlib.crc32(w.lower()) % Q.BUCKETS].astype(float) / len(words)
            s = shape_of(w)
            shape += shapes[zlib.crc32(s[:1] + s[-3:]) % Q.SHAPES] / len(words)
        n, lines = len(words), text.split("\n")
        ratios = [np.log(1 + n), len(set(words)) / n, len(text) / n / 10, len(set(lines)) / len(lines), max(map(words.count, words)) / n, np.sqrt((word**2).sum())]
        assert np.allclose(row, [*word, *shape, *ratios], atol=1e-4)


def test_score_is_the_network_and_its_temperature(spark):
    import math

    rng = np.random.default_rng(4)
    width = Q.DIM + Q.SHAPE_DIM + Q.RATIOS
    weights = (rng.normal(size=(width, 5)), rng.normal(size=5), rng.normal(size=5), np.float64(0.3))
    vectors = rng.normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float16)
    model = Q.Model(vectors, weights, rng.normal(size=width), rng.uniform(0.5, 2, width), 1.7, 0.5)
    texts = ["one two three", "", "Zwei, DREI!\n4", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score(df, model).collect()}
    for k, text in enumerate(texts):
        x = [(a - m) / s for a, m, s in zip(Q.features([text or ""], vectors)[0].astype(float), model.mean, model.scale)]
        z = 0.3
        for j in range(5):
            z += math.tanh(sum(x[i] * weights[0][i, j] for i in range(width)) + weights[1][j]) * weights[2][j]
        assert abs(got[k] - 1 / (1 + math.exp(-z / 1.7))) < 1e-9


def test_gradients_and_temperature():
    rng = np.random.default_rng(6)
    weights = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.2)]
    a, t = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    loss = lambda: Q._log_loss(Q._logit(a, tuple(weights)), t) + 0.5e-4 * ((weights[0] ** 2).sum() + (weights[2] ** 2).sum())
    for w, g in zip(weights, Q._gradients(weights, a, t)):
        for at in np.ndindex(w.shape):
            was = w[at]
            w[at] = was + 1e-6
            up = loss()
            w[at] = was - 1e-6
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-6 - np.asarray(g)[at]) < 1e-6
    logits = rng.normal(size=4000) * 3
    y = (rng.random(4000) < Q._sigmoid(logits / 2.5)).astype(float)
    best = Q._temperature(logits, y)
    assert 2 < best < 3.2 and all(Q._log_loss(logits / best, y) <= Q._log_loss(logits / k, y) + 1e-4 for k in (0.5, 1, 2, 2.2, 2.8, 4, 8))
