import hashlib
import os

import numpy as np
import pyarrow as pa
import xxhash

from textloom.llm import lz_fingerprint as L
from textloom.llm.queries import op10_lz_fingerprint
from textloom.session import shared_root


def plain(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


# The 64 permutations, as the method fixes them: seed 20, odd factors, then shifts, modulo 2 ** 64.
_rng = np.random.default_rng(20)
FACTORS = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]
SHIFTS = [int(x) for x in _rng.integers(0, 1 << 63, 64, dtype=np.uint64)]


def plain_signature(text):
    hashes = [xxhash.xxh3_64_intdigest(p.encode()) for p in plain(text)]
    return [min(((h * f + s) % (1 << 64) for h in hashes), default=(1 << 64) - 1) % (1 << 32) for f, s in zip(FACTORS, SHIFTS)]


def shown(signature):
    return b"".join(x.to_bytes(4, "little") for x in signature).hex()


def same(a, b):
    return sum(x == y for x, y in zip(a, b)) / 64


def check(rows, got):
    """Every row against a plain parse and plain signatures; rows of one id come in any order of their texts' hashes."""
    of, signatures = {}, {}
    sign = lambda t: signatures.setdefault(t, plain_signature(t)) if len(t) < 5000 else plain_signature(t)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)
    assert len({r[0] for r in rows}) == len(rows) or len(rows) < 3, "ids differ here"
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (sign(x) for x in (t, edited, after))
        of[i] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), same(a, b), same(a, c))
    assert len(got) == len(rows) and {r[0]: r for r in got} == of


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in op10_lz_fingerprint(spark, sf).collect()]
    check(rows, got)
    edited, after = np.mean([r[5] for r in got]), np.mean([r[6] for r in got])
    print("near_edited", edited, "near_next", after)
    assert edited > 2 * after


def test_blocks_nulls_and_ties(spark):
    texts = [None, "", "a", "ab" * 500, "é😀", "the cat sat", "x" * 40000, "the cat sat on"] * 6
    texts[6::8] = ["x" * (2000 + k) for k in range(len(texts[6::8]))]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, "?", 1) for i, t in rows], "doc_id long, text string, fingerprint string, block int")
    for per in (1, 5, 1000):
        check(rows, [tuple(r) for r in L.edited_pairs(df.repartition(3), per_block=per).collect()])
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "b")], "doc_id long, text string")
    got = L.edited_pairs(twice, per_block=1).collect()
    assert [r.doc_id for r in got].count(1) == 2 and len(got) == 3
    assert L.edited_pairs(df.limit(0)).count() == 0
    names = spark.createDataFrame([(None if i is None else f"d{i:04}é", t) for i, t in rows], "doc_id string, text string")
    got = [tuple(r) for r in L.edited_pairs(names.repartition(3), per_block=2).collect()]
    ids = {None if i is None else f"d{i:04}é": i for i, _ in rows}
    check(rows, [(ids[r[0]], *r[1:]) for r in got])
    one = L.edited_pairs(df.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_tracks_shared_phrases():
    a = plain("the quick brown fox jumps over the lazy dog " * 20)
    b = plain("the quick brown fox jumps over the lazy cat " * 20)
    exact = len(a & b) / len(a | b)
    got = L.likeness(*(L.signature(L.minima(sorted(x))) for x in (a, b)))
    assert abs(got - exact) < 0.2


def test_runs_of_one_id_cross_blocks(spark):
    """Half of all rows repeat one id and text, others one id or none: each has a next row, and few see another text."""
    rows = [(5, "copied text " * 5)] * 400 + [(None, "lost text " * 5)] * 200 + [(7, f"text {k}") for k in range(100)] + [(k, f"other {k}") for k in range(10, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for per in (20, 64):
        blocks = L.neighbours(df, per_block=per)
        sizes = [r["count"] for r in blocks.filter("NOT guest").groupBy("block").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 5 * per + 100
        assert blocks.filter("guest").groupBy("block").count().filter("count <> 1").count() == 0
        got = L.edited_pairs(df, per_block=per).collect()
        assert len(got) == len(rows)
        assert sum(r.near_next < 1 for r in got if r.doc_id == 5) == 1 and sum(r.near_next < 1 for r in got if r.doc_id is None) == 1
        text, after = "copied text " * 5, "lost text " * 5
        edited = [text[:-20] + x for x in (text[:20], after[:20])]
        want = {hashlib.sha256(x.encode()).hexdigest() for x in edited}
        assert {r.edited_sha256 for r in got if r.doc_id == 5} == want


def test_places_of_many_rows():
    """The vectors' way against a walk over all blocks, for numbers and texts, with nulls and long runs of one id and text."""
    rng = np.random.default_rng(8)
    for kind in (pa.int64(), pa.string()):
        made = [(int(rng.integers(40)), int(rng.integers(-4, 4))) for _ in range(300)] + [(7, 2)] * 60 + [(None, -1)] * 40
        keys = [(i is not None, i if kind == pa.int64() or i is None else f"é{i:03}", h) for i, h in made]
        order = sorted(keys, key=lambda k: (k[0], k[1] if k[0] else 0, k[2]), reverse=True)
        for leads in (order[::9], order[::150], order[:1], [k for k in order[::9] if k[0]]):
            got = L.places(leads, pa.array([k[1] for k in keys], kind), np.array([k[2] for k in keys]), np.arange(len(keys)))
            for key, at in zip(keys, got):
                rank = lambda k: (k[0], k[1] if k[0] else 0, k[2])
                alike = [b for b, lead in enumerate(leads) if rank(lead) == rank(key)]
                before = [b for b, lead in enumerate(leads) if rank(lead) > rank(key)]
                allowed = set(alike) | ({before[-1]} if before else set() if alike else {0})
                assert at in allowed, (key, at, allowed)
            run = {at for key, at in zip(keys, got) if key[1] in (7, "é007") and key[2] == 2}
            assert len(run) >= min(3, sum(k[1] in (7, "é007") and k[2] == 2 for k in leads))


def test_blocks_grow_with_bytes_up_to_their_most(spark, monkeypatch):
    df = spark.createDataFrame([(k, "word " * 40) for k in range(600)], "doc_id long, text string")
    monkeypatch.setattr(L, "BLOCK_BYTES", 4_000)
    assert 20 < len(L._leads(df, "text", None)) <= 30
    monkeypatch.setattr(L, "MOST_BLOCKS", 15)
    assert len(L._leads(df, "text", None)) <= 15
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert L.edited_pairs(df).filter("near_next = 1").count() == 600


def test_blocks_are_found_without_files(spark):
    """No file is written to find where blocks begin, and the first rows are those of a sorted table, in order."""
    root = shared_root(spark).removeprefix("file:")
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(root) for x in names}
    before = files()
    df = spark.createDataFrame([(k * 37 % 1000, f"text {k % 9}") for k in range(1000)], "doc_id long, text string").repartition(7)
    leads = L._leads(df, "text", 50)
    assert files() == before
    ids = [i for _, i, _ in leads]
    assert 15 <= len(ids) <= 20 and ids[0] == 999 and ids == sorted(ids, reverse=True) and max(np.abs(np.diff(ids))) < 200
    list(L.edited_pairs(df, per_block=50).toLocalIterator())
    assert files() == before
