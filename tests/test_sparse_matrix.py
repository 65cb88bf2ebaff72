"""Sparse matrix files: round trips, ranges of columns, long columns, and writes that count only when complete."""

import json
import os
import random

import pytest
from textloom.sources import sparse_matrix as M


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/matrix"


def entries(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, value double")


def plain(df):
    return sorted((r["col"], r["row"], r["value"]) for r in df.select("row", "col", "value").collect())


def some(n=3000, seed=1):
    rng = random.Random(seed)
    # A third of the entries are in one column; some are repeated, some columns and rows are negative or far.
    return [(rng.randrange(10**12) - 5, 7 if k % 3 == 0 else rng.randrange(-20, 400), rng.choice([0.0, 1.0, -2.5])) for k in range(n)] + [(1, 1, 2.0)] * 3


def manifest(path):
    return json.load(open(f"{path[7:]}/{M.MANIFEST}"))


@pytest.mark.parametrize("batch", ["1000000", "10"])
def test_round_trip_and_ranges(spark, path, batch):
    rows = some()
    given = entries(spark, rows).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        M.write_matrix(given, path, files=6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((c, r, v) for r, c, v in rows)
    assert plain(M.read_matrix(spark, path)) == want
    held = manifest(path)
    assert len(held) == 6 and sum(m["entries"] for m in held) == len(rows)
    assert sum(m["first"] <= 7 <= m["last"] for m in held) > 1  # the long column is cut
    for first, last in ((7, 7), (-100, 3), (100, None), (None, 0), (398, 10_000), (5000, None)):
        low, high = (-(10**9) if first is None else first), (10**9 if last is None else last)
        found = M.read_matrix(spark, path, first, last)
        assert plain(found) == [w for w in want if low <= w[0] <= high]
        if (first, last) == (100, None):
            assert found.rdd.getNumPartitions() < 6


def test_conditions_leave_out_files(spark, path):
    rows = some()
    M.write_matrix(entries(spark, rows), path, files=6)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for text, test in {
            "col = 150": lambda c: c == 150, "col > 150 AND col <= 170": lambda c: 150 < c <= 170, "col IN (1, 3)": lambda c: c in (1, 3),
            "col < 0": lambda c: c < 0, "col = 7 OR row = 1": None, "col IS NULL": lambda c: False,
        }.items():
            found = M.read_matrix(spark, path).filter(text)
            assert plain(found) == sorted((c, r, v) for r, c, v in rows if (test(c) if test else c == 7 or r == 1)), text
        assert M.read_matrix(spark, path).filter("col = 150").rdd.getNumPartitions() < 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_nulls_other_names_and_no_entries(spark, path):
    odd = spark.createDataFrame([(1, 2, 3.0, "x"), (None, 2, 1.0, "x"), (1, None, 1.0, "x"), (1, 2, None, "x")], "a int, b int, c double, row string")
    M.write_matrix(odd, path, "a", "b", "c")
    assert plain(M.read_matrix(spark, path)) == [(2, 1, 3.0)]
    M.write_matrix(entries(spark, []), path, mode="overwrite")
    assert plain(M.read_matrix(spark, path)) == []


def test_only_what_is_committed_counts(spark, path):
    M.write_matrix(entries(spark, [(1, 1, 1.0)]), path)
    M.write_matrix(entries(spark, [(2, 1, 2.0)]), path)
    with open(f"{path[7:]}/0123.arrow", "wb") as left:
        left.write(b"half a file")
    assert plain(M.read_matrix(spark, path)) == [(1, 1, 1.0), (1, 2, 2.0)]
    M.write_matrix(entries(spark, [(3, 3, 3.0)]), path, mode="overwrite")
    assert plain(M.read_matrix(spark, path)) == [(3, 3, 3.0)]
    writer = M.Writer(path, False, 10)
    message = writer.write(iter([M.pa.RecordBatch.from_pydict({"row": [1], "col": [9], "value": [1.0]}, schema=M._READ)]))
    writer.abort([message, None])
    assert not os.path.exists(f"{path[7:]}/{message.file}") and plain(M.read_matrix(spark, path)) == [(3, 3, 3.0)]
