"""The joint learner against plain numpy: the same steps, and steps that lead to the optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.operators import sparse_learner as L

LABELS = ["x", "y", "z"]


def corpus(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(25)]
    lean = {"x": slice(0, 6), "y": slice(6, 12), "z": slice(12, 18)}
    rows = []
    for k in range(n):
        label = ["x", "y", "z", "other"][k % 4]
        own = rng.choice(words, 6).tolist() + (rng.choice(words[lean[label]], 4).tolist() if label in lean else [])
        rows.append((k, label, own if k % 40 else [], k % 5))
    rows += [(n, None, ["w1", "unseen"], 0), (n + 1, "x", None, 0)]
    return rows, spark.createDataFrame(rows, "post_id long, label string, words array<string>, q int").repartition(3)


def matrices(model, rows):
    ids = {r["word"]: r["word_id"] - 1 for r in model.vocabulary.collect()}
    x = np.zeros((len(rows), model.words + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for w in r[2] or []:
            if w in ids:
                x[i, ids[w]] += 1
    y = np.array([[float(r[1] == t) for t in LABELS] for r in rows])
    return (x > 0).astype(float) if model.binary else x, y


def plain(x, y, points, steps):
    """ADAGrad on all posts, for each point and label alone."""
    out = np.zeros((x.shape[1], y.shape[1], len(points)))
    for t in range(y.shape[1]):
        for j, p in enumerate(points):
            w, squares = np.zeros(x.shape[1]), np.zeros(x.shape[1])
            for step in range(steps):
                g = x.T @ (1 / (1 + np.exp(-x @ w)) - y[:, t]) / len(x) + p.l1 * np.sign(w)
                squares += g * g
                w = w - p.rate * g / np.sqrt(np.maximum(squares, 1e-20)) / (step + 1) ** p.texp
            out[:, t, j] = w
    return out


def weights(model):
    return model.plain().gather(np.arange(model.words + 1)).reshape(model.words + 1, len(model.labels), len(model.points))


POINTS = (L.Point(1.0, 0.0, 0.0), L.Point(0.1, 0.5, 1e-3), L.Point(0.5, 0.25, 1e-2))


@pytest.mark.parametrize(("binary", "shard_bytes", "buffer"), [(False, 16 << 20, 32 << 20), (True, 900, 2000)])
def test_all_labels_and_points_take_numpy_s_steps(spark, monkeypatch, binary, shard_bytes, buffer):
    monkeypatch.setattr(L, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(L, "BUFFER", buffer)
    rows, df = corpus(spark)
    model = L.train(df, LABELS, POINTS, n_words=24, passes=4, binary=binary)
    assert model.words == 24 and model.step == 4 and (model.shards > 1) == (shard_bytes < 1000)
    x, y = matrices(model, rows)
    assert np.allclose(weights(model), plain(x, y, POINTS, 4), atol=1e-9)
    p = {r["post_id"]: r["p"] for r in L.probabilities(model, df).collect()}
    want = 1 / (1 + np.exp(-np.einsum("ij,jtp->itp", x, weights(model))))
    assert len(p) == len(rows) and all(np.allclose(p[r[0]], want[i].ravel()) for i, r in enumerate(rows))


def test_the_steps_lead_to_the_optimum():
    """What the learner does at each step ends where the gradient of the log-loss is near zero."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.poisson(0.4, (300, 8)), np.ones(300)])
    y = (rng.random((300, 1)) < 1 / (1 + np.exp(-x @ rng.normal(size=(9, 1))))).astype(float)
    w = plain(x, y, (L.Point(1.0, 0.0, 0.0),), 3000)[:, :, 0]
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x)).max() < 1e-4


def test_one_job_a_pass_and_no_old_files(spark):
    from pyarrow import fs

    rows, df = corpus(spark)
    tracker = spark.sparkContext.statusTracker()
    done = []
    for passes in (1, 4):
        spark.sparkContext.setJobGroup(f"passes-{passes}", "")
        model = L.train(df, LABELS, POINTS, passes=passes)
        done.append(len(tracker.getJobIdsForGroup(f"passes-{passes}")))
    spark.sparkContext.setJobGroup("", "")
    # Adaptive execution runs a step's shuffle and its result as one job each.
    assert (done[1] - done[0]) / 3 <= 2
    store, root = fs.FileSystem.from_uri(model.folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(root))]
    assert sorted(names) == ["g3-0.npy", "g4-0.npy", "w3-0.npy", "w4-0.npy"]


def test_mini_batches_predictions_and_grid_scores(spark):
    rows, df = corpus(spark)
    train, held = df.filter("post_id % 4 <> 1 OR post_id % 3 = 0"), df.filter("post_id % 3 = 1")
    model = L.train(train, LABELS, POINTS, passes=3, batches=4)
    assert model.step == 12
    got = L.predict(model, held)
    assert got.columns[-4:] == ["p_x", "p_y", "p_z", "predicted"] and "q" in got.columns
    known = got.filter("label <> 'other' AND size(words) > 0")
    assert known.filter("label = predicted").count() / known.count() > 0.7
    cells = L.grid_scores(model, held).collect()
    assert len(cells) == 9 and all(c["auc"] > 0.7 for c in cells if c["point"] == 0)
    scored = {r["post_id"]: r for r in got.collect()}
    pairs = [(r["p_y"], r["label"] == "y") for r in scored.values()]
    area = np.mean([(a > b) + 0.5 * (a == b) for a, s in pairs if s for b, t in pairs if not t])
    assert abs(next(c["auc"] for c in cells if c["label"] == "y" and c["point"] == 0) - area) < 1e-5


def test_network_takes_numpy_s_steps(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_BYTES", 500)
    rows, df = corpus(spark)
    model = L.train(df, LABELS, (L.Point(0.5, 0.4, 1e-4),), n_words=24, hidden=5, passes=3)
    x, y = matrices(model, rows)
    start = model.plain()._replace(step=0)
    w = np.concatenate([start.start(k) for k in range(model.shards)])
    v = start.start(model.shards)
    assert w.shape == (25, 5) and v.shape == (6, 3) and model.shards > 1
    gw, gv = np.zeros_like(w), np.zeros_like(v)
    for step in range(3):
        h = np.column_stack([1 / (1 + np.exp(-x @ w)), np.ones(len(x))])
        back = 1 / (1 + np.exp(-h @ v)) - y
        dv = h.T @ back / len(x) + 1e-4 * np.sign(v)
        dw = x.T @ ((back @ v[:-1].T) * h[:, :-1] * (1 - h[:, :-1])) / len(x) + 1e-4 * np.sign(w)
        gw, gv = gw + dw**2, gv + dv**2
        w, v = w - 0.5 * dw / np.sqrt(gw) / (step + 1) ** 0.4, v - 0.5 * dv / np.sqrt(gv) / (step + 1) ** 0.4
    assert np.allclose(model.plain().gather(np.arange(25)), w, atol=1e-9) and np.allclose(model.plain().top(), v, atol=1e-9)
    h = np.column_stack([1 / (1 + np.exp(-x @ w)), np.ones(len(x))])
    p = {r["post_id"]: r["p"] for r in L.probabilities(model, df).collect()}
    assert all(np.allclose(p[r[0]], (1 / (1 + np.exp(-h @ v)))[i]) for i, r in enumerate(rows))


def test_network_separates_what_no_line_does(spark):
    rows = [(k, ["a"] * (k % 2) + ["b"] * (k // 2 % 2), "yes" if (k % 2) != (k // 2 % 2) else "no") for k in range(80)]
    df = spark.createDataFrame(rows, "post_id long, words array<string>, label string")
    model = L.train(df, ["yes"], (L.Point(0.5),), hidden=16, passes=80)
    got = L.probabilities(model, df.limit(4)).select("label", F.col("p")[0].alias("p")).collect()
    assert all((r["p"] > 0.5) == (r["label"] == "yes") for r in got)


def test_no_posts(spark):
    rows, df = corpus(spark)
    model = L.train(df.limit(0), LABELS, POINTS, passes=2)
    assert model.words == 0 and {tuple(r["p"]) for r in L.probabilities(model, df).collect()} == {(0.5,) * 9}
