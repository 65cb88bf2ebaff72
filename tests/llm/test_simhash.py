import random
import time

import numpy as np
import pytest
import xxhash

from textloom.llm.components import components
from textloom.llm.queries import op8_simhash
from textloom.llm.simhash import keep_one, link, near_duplicates, sweep, variants


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    """fp to the least fp of its component, by comparing all with all."""
    arr, label = np.array(fps, np.uint64), {}
    for i, f in enumerate(fps):
        if f in label:
            continue
        todo, label[f] = [f], f
        while todo:
            x = np.uint64(todo.pop())
            for y in arr[np.bitwise_count(arr ^ x) <= bits].tolist():
                if y not in label:
                    label[y] = f
                    todo.append(y)
    return label


def check(rows, got):
    fps = {t: plain_fingerprint(t) for _, t in rows}
    label = classes(sorted(set(fps.values())))
    least = {}
    for i, t in rows:
        if i is not None:
            c = label[fps[t]]
            least[c] = min(i, least.get(c, i))
    want = sorted((repr(i), format(fps[t], "016x"), least.get(label[fps[t]])) for i, t in rows)
    assert sorted((repr(a), b, c) for a, b, c in got) == want


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, [tuple(r) for r in op8_simhash(spark, sf).collect()])


def test_nulls_ties_and_empty(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (7, "a B c"), (8, "A b C"), (8, "a b c"), (None, "a b c"), (None, "only me"), (9, "a b c d e\x85f"), (10, "x " * 30000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = near_duplicates(df)
    check(rows, [(r.doc_id, format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in got.collect()])
    assert near_duplicates(df.limit(0)).count() == 0


def planted(seed):
    rnd = random.Random(seed)
    fps = set()
    for _ in range(60):  # chains and crowds of fingerprints up to 5 bits apart
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 40])):
            fps.add(f)
            g = f
            for _ in range(rnd.randrange(1, 6)):
                g ^= 1 << rnd.randrange(64)
            f = rnd.choice([f, g])
            fps.add(g)
    return fps


@pytest.mark.parametrize("hot", [None, 64])
def test_links_of_planted_fingerprints(spark, hot):
    """hot 64: every key met twice in the sample is cut before the shuffle."""
    fps = planted(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    links = link(df, hot=hot)
    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    got = {r.node: r.root for r in components(links).collect()}
    label = classes(sorted(fps))
    by = {}
    for f in fps:
        by.setdefault(label[f], set()).add(got.get(signed(f), signed(f)))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_sweep_of_a_crowd_under_one_key():
    """100,000 unrelated fingerprints that share a segment, and some near ones among them."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2) & ~np.uint64((1 << 21) - 1) | np.uint64(0x12345)
    near = fps[:500].copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(21, 64, 500, dtype=np.uint64)
    near[::2] ^= np.uint64(1)  # the wildcard's place
    near[::2] ^= np.uint64(1) << np.uint64(63)
    key = variants(fps[:1], 4)[0, 0]
    every = np.sort(np.concatenate([fps, near]))
    began = time.time()
    a, b = sweep(np.full(len(every), key), every, 4)
    assert time.time() - began < 10
    assert (np.bitwise_count(a ^ b) <= 4).all()
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    want = [(int(x), int(y)) for x, y in zip(fps[:500], near) if int(x ^ y).bit_count() <= 4 and x != y]
    assert len(want) > 200 and all(find(x) == find(y) for x, y in want)


def test_sweep_of_near_copies_is_not_quadratic():
    fps = np.unique(np.array([sum(1 << b for b in random.Random(k).sample(range(30, 60), 2)) for k in range(3000)], np.uint64))
    a, _ = sweep(np.full(len(fps), np.uint64(0)), fps, 4)
    assert len(a) < 6 * len(fps)


def test_keep_one_with_clashing_names_and_ids_of_text(spark, monkeypatch):
    schema = "doc_id string, text string, _id int, _hash int, component int, fp int, _stays int, n int"
    words = " ".join(f"w{k}" for k in range(400))
    rows = [("a", words), ("b", words), ("b", words), ("c", words + " more"), ("d", "other text here"), ("d", "other text here"), (None, None), (None, None), (None, "lone text of its own")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], schema)
    for limit in (1_000_000, 0):
        monkeypatch.setattr("textloom.llm.simhash.BROADCAST_ROWS", limit)
        got = keep_one(df).collect()
        assert sorted((repr(r.doc_id), r.text or "") for r in got) == [("'a'", words), ("'d'", "other text here"), ("None", ""), ("None", "lone text of its own")]
        assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6) for r in got)
    assert keep_one(df.limit(0)).count() == 0
