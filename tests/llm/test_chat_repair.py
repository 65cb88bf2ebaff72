import hashlib
import random
import re

import pyarrow as pa
import pytest

from textloom.llm import chat_repair as r

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """(role, text, fault) of a conversation's rows, each row compared with all before it."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    out = []
    for k, (_, role, text) in enumerate(rows):
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in [x[1:] for x in rows[:k]] else "t" if body[-1] not in ".!?" else ""
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """By trying all edits that could be of use: at most two inserts stand together."""
    best = None

    def go(k, cost, audit, out, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and LEGAL.match("".join(x.split(":")[0][:1] for x in out)):
            found = (cost, audit, "\n".join(out))
            best = min(best, found) if best else found
        if inserts < 2:
            for role in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*out, f"{role}:"], inserts + 1)
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, cost + 4, audit + "D", out, 0)
            if fault not in ("b", "d"):
                late = 3 if fault == "t" else 0
                go(k + 1, cost + late, audit + "K", [*out, f"{role}:{text}"], 0)
                for to in ("user", "assistant"):
                    go(k + 1, cost + late + 3, audit + "R", [*out, f"{to}:{text}"], 0)

    go(0, 0, "", [], 0)
    return best


def linear(rows):
    """The same by states, row by row, in plain Python."""
    best = {0: (0, "", ())}
    into = {"user": ((0, 1, 3), 2), "assistant": ((2,), 3)}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for role, (froms, to) in into.items():
                for s in froms:
                    if s in out:
                        c, a, o = out[s]
                        out[to] = min(out.get(to, (1e9,)), (c + 3, a + "I", (*o, f"{role}:")))
        return out

    for role, text, fault in rows:
        new, now = {}, inserted(best)
        late = 3 if fault == "t" else 0

        def put(s, value):
            new[s] = min(new.get(s, (1e9,)), value)  # noqa: B023

        for s, (c, a, o) in now.items():
            put(s, (c + 4, a + "D", o))
            if fault in ("b", "d"):
                continue
            if s == 0 and role[:1] == "s":
                put(1, (c + late, a + "K", (*o, f"{role}:{text}")))
            for to, (froms, t) in into.items():
                if s in froms:
                    keep = role[:1] == to[0]
                    put(t, (c + late + (0 if keep else 3), a + ("K" if keep else "R"), (*o, f"{role if keep else to}:{text}")))
        best = new
    c, a, o = min(v for s, v in inserted(best).items() if s in (0, 3))
    return c, a, "\n".join(o)


def repaired(spark, rows, copies=None):
    df = spark.createDataFrame([(*x, 1 if copies is None else copies[k]) for k, x in enumerate(rows)], SCHEMA + ", copies long").repartition(3)
    found = r.repair(df)
    hashes = {x["conv_id"]: x["repaired_sha256"] for x in r.digest(found.rows).collect()}
    return {x["conv_id"]: (*(x[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), hashes.get(x["conv_id"])) for x in found.report.collect()}


def expected(rows, solve):
    """Of one conversation: what repaired() returns."""
    rows = [(t, " " if a is None else a, " " if b is None else b) for t, a, b in rows]
    marked = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [x[0][:1] for x in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    cost, audit, out = solve(marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [sum(x[2] == f for x in marked) for f in "bdt"]
    return gaps, *count, illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest() if out else None


def some_rows(rng, n):
    texts = ["ok.", "why?", "cut off", "", " \n", "ok.", "b. \t"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    return [(rng.choice([k, k, k, k // 2, None]), rng.choice(roles), rng.choice(texts) + rng.choice(["", str(k) + "."])) for k in range(n)]


def test_small_conversations_equal_all_edits(spark):
    rng = random.Random(4)
    convs = {c: some_rows(rng, rng.randint(1, 4)) for c in range(60)}
    got = repaired(spark, [(c, *x) for c, rows in convs.items() for x in rows])
    assert got == {c: expected(rows, cheapest) for c, rows in convs.items()}


def test_long_conversations_over_blocks_and_partitions(spark):
    rng = random.Random(5)
    convs = {c: some_rows(rng, n) for c, n in enumerate((1, 63, 64, 65, 300, 700, 5))}
    convs[None] = some_rows(rng, 130)
    got = repaired(spark, [(c, *x) for c, rows in convs.items() for x in rows])
    assert got == {c: expected(rows, linear) for c, rows in convs.items()}


def test_the_two_brute_forces_agree():
    rng = random.Random(6)
    for _ in range(200):
        marked = faults([(k, a, b) for k, (_, a, b) in enumerate(some_rows(rng, rng.randint(0, 4)))])
        assert linear(marked) == cheapest(marked)


def test_copies_nulls_and_conversations_that_vanish(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "user", "x."), (3, 0, None, None), (4, None, "user", "x."), (4, None, "assistant", "é?")]
    got = repaired(spark, rows, [2, 1, 0, 1, 1, 1])
    assert got[1][:7] == (0, 0, 1, 0, 0 + 1, 4, "KDK")
    assert got[2] == (0, 0, 0, 0, 0, 0, "", None)
    assert got[3] == (0, 1, 0, 0, 0, 4, "D", None)
    # Nulls come first, then by role: the assistant stands before the user.
    assert got[4] == expected([(None, "user", "x."), (None, "assistant", "é?")], linear)


def test_many_equal_rows_of_one_conversation(spark):
    rows = [(7, 0, "user", "same.")] * 500 + [(7, k, "user", "same.") for k in range(200)] + [(7, 900, "assistant", "end.")]
    got = repaired(spark, rows)[7]
    assert got[1:5] == (0, 699, 0, 699) and got[5] == 4 * 699 and got[6] == "K" + "D" * 699 + "K"


def test_empty_table_and_other_types(spark):
    assert repaired(spark, []) == {}
    df = spark.createDataFrame([("x", 1, "tool", "a." + "z" * 100_000 + ".", 5)], "conv_id string, turn int, role string, text string, cost int")
    fixed = r.repair(df)
    assert fixed.report.first()["audit"] == "D" and fixed.rows.count() == 0
    fixed = r.repair(df.withColumn("text", df["text"].substr(1, 100)).withColumn("role", df["role"].substr(1, 0)).union(df.limit(0)))
    assert fixed.report.first()["audit"] == "D"
    fixed = r.repair(df.withColumn("role", df["role"].substr(9, 1)).unionByName(df.selectExpr("conv_id", "2 AS turn", "'assistant' AS role", "'b.' AS text", "1 AS cost")))
    assert fixed.report.first()["audit"] == "RK" and [x["role"] for x in fixed.rows.orderBy("at", "part").collect()] == ["user", "assistant"]


@pytest.mark.parametrize("symbols", ["", "s", "0", "uaua", "sxUo"])
def test_blocks_from_any_state(symbols):
    solved = r.advance(r.solver(), pa.array([symbols, "ua"]))
    assert len(solved) == 2 and solved[1][0][0][3] == 0 and solved[1][0][1][3] == "KK"
    assert len(solved[0]) == 4 and all(solved[0][s][1][s] == "D" * len(symbols) for s in (0, 1))


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "Hi. You? No!x") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = {(x["conv_id"], x["turn"]): x for x in r.damage(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, t, *_ in rows[:-1]:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = got[c, t]
        assert row["copies"] == {0: 0, 3: 2}.get(kind, 1)
        assert row["text"] == {1: "", 2: "Hi You Nox"}.get(kind, "Hi. You? No!x") and row["role"] == ("user" if kind == 4 else "assistant")
    assert got[None, None]["copies"] == {0: 0, 3: 2}.get(zlib.crc32(b" : ") % 20, 1)
