import random

import numpy as np

from textloom.llm.mixing import balance_sources

SCHEMA = "doc_id long, source string, text string, size int, u int"


def water(sizes, weights, share=1.5, cap=2.0):
    full, total = set(), share * sum(sizes)
    while True:
        rest = sum(w for i, w in enumerate(weights) if i not in full)
        level = (total - sum(cap * sizes[i] for i in full)) / rest if rest else 0
        more = {i for i, w in enumerate(weights) if i not in full and level * w > cap * sizes[i]}
        if not more:
            return [cap * s if i in full else level * w for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= more


def test_targets_and_copies(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "c", "é", None, "hot", "hot", "hot", "hot"]), "w " * rnd.randrange(1, 60), 1, 1) for i in range(1200)]
    rows += [(None, "a", None, 1, 1), (3, "a", "", 1, 1), (3, "a", "", 1, 1), (4, "empty", None, 1, 1)]
    got = balance_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    sizes = [sum(g.size for g in got if g.source == n) for n in names]
    targets = water(sizes, [[3.0, 1.0, 2.0][i % 3] for i in range(len(names))])
    for n, s, t in zip(names, sizes, targets):
        own = [g for g in got if g.source == n]
        assert all(g.source_size == s and abs(g.target - t) < 1e-6 for g in own), (n, t, own[0])
        assert abs(sum(g.copies * g.size for g in own) - t) <= 60, n
        assert all(0 <= g.copies <= 2 for g in own)
    again = balance_sources(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.copies)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert balance_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_rates(sizes, target, cap=2.0):
    """The dual by halving, without Newton's steps."""
    sizes = np.array(sizes, float)
    scale = sizes[sizes > 0].mean()
    rates = lambda lam: np.minimum(cap, np.exp(np.minimum(lam * sizes / scale, 100)))
    lo, hi = -1e4, 1e4
    for _ in range(200):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if (sizes * rates(middle)).sum() < target else (lo, middle)
    return rates(lo)


def test_rates_solve_the_dual(spark):
    rnd = random.Random(3)
    size = {"thin": lambda: rnd.randrange(1, 80), "tail": lambda: int(rnd.paretovariate(1.1)), "grow": lambda: rnd.randrange(1, 9), "full": lambda: 1}
    rows = [(i, s, "w " * min(size[s](), 4000), 1, 1) for i, s in enumerate([*["thin"] * 900, *["tail"] * 700, *["grow"] * 500, *["full"] * 50])]
    got = balance_sources(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    for source in size:
        own = [g for g in got if g.source == source]
        if own[0].target >= 2 * own[0].source_size:
            assert {g.rate for g in own} == {2.0}
            continue
        want = plain_rates([g.size for g in own], own[0].target)
        assert max(abs(g.rate - w) for g, w in zip(own, want)) < 1e-5
        assert len({round(g.rate, 4) for g in own}) > 5
        assert abs(sum(g.rate * g.size for g in own) / own[0].target - 1) < 1e-4
        assert all(g.copies in (int(g.rate), int(g.rate) + 1) for g in own)
        assert abs(sum(g.copies * g.size for g in own) - own[0].target) <= max(g.size for g in own)


def test_targets_with_many_sources_at_their_caps(spark):
    rows = [(i, f"s{i:04}", "w " * (i + 1), 1, 1) for i in range(60)]
    got = {g.source: g for g in balance_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    names = sorted(got)
    want = water([got[n].source_size for n in names], [[3.0, 1.0, 2.0][i % 3] for i in range(len(names))])
    assert all(abs(got[n].target - t) < 1e-6 for n, t in zip(names, want))


def sql_taken(rows):
    """Words taken by source, by the query's SQL over the same rows."""
    import duckdb
    import pandas as pd

    from textloom.llm.queries import OP5_SQL

    frame = pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    return {s: (t, n) for s, t, n in con.execute(f"SELECT any_value(source), any_value(target), sum(taken) FROM ({OP5_SQL}) JOIN (SELECT DISTINCT doc_id, source FROM documents) AS d USING (doc_id) GROUP BY source").fetchall()}


def taken(spark, rows, parts=4, **options):
    got = balance_sources(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options).collect()
    assert len(got) == len(rows)
    return {s: (max(g.target for g in got if g.source == s), sum(g.copies * g.size for g in got if g.source == s)) for s in {g.source for g in got}}, got


def test_targets_are_met_on_null_and_repeated_ids(spark):
    ten = "w " * 10
    nulls = [(None, "a", ten, 1, 1)] * 1000
    found, got = taken(spark, nulls)
    assert found == {"a": (15_000.0, 15_000)} and {g.copies for g in got} <= {1, 2}
    repeated = [(7, "a", ten, 1, 1)] * 1000 + [(k, "a", ten, 1, 1) for k in range(20, 30)]
    found, _ = taken(spark, repeated)
    assert found["a"][0] == 15_150 and abs(found["a"][1] - 15_150) <= 10
    assert sql_taken(repeated) == {"a": (15_150.0, found["a"][1])}


def test_repeats_in_several_sources_with_other_columns(spark):
    rnd = random.Random(8)
    rows = [(None if s == "b" else 5, s, f"x{rnd.randrange(3)} " * rnd.choice([4, 4, 4, 9]), 1, rnd.randrange(4)) for s in "abcd" * 150]
    found, got = taken(spark, rows, keep=("text", "u"))
    for target, words in found.values():
        assert abs(words - target) <= 9
    key = lambda g: (g.source, g.text, g.copies)
    again = taken(spark, rows, 7, keep=("text", "u"))[1]
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_an_unsolved_source_is_an_error(spark, monkeypatch):
    import pytest
    from textloom.llm import mixing

    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    rows = [(k, "ab"[k % 2], "w " * (1 + k % 17), 1, 1) for k in range(200)]
    with pytest.raises(ValueError, match="doesn't|don't meet"):
        balance_sources(spark.createDataFrame(rows, SCHEMA)).collect()
