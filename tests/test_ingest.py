"""Files that arrive in lots, and mini-batches of files."""

from collections import Counter

import pytest
from textloom.sources.mini_batches import each_batch, mini_batches
from textloom.streaming import ingest


def post(text, user="u"):
    return f"<posts><post><user>{user}</user><event><string>{text}</string></event></post><post><user>{user}</user></post></posts>"


def test_each_file_is_tokenised_once(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.xml").write_text(post("one two two"))
    (source / "notes.txt").write_text(post("not this"))
    assert ingest.tokenise_new(spark, str(source), target) == 1
    assert ingest.tokenise_new(spark, str(source), target) == 0
    (source / "b.xml").write_text(post("two three", "v") + post("four", "w"))
    assert ingest.tokenise_new(spark, str(source), target) == 2
    rows = [(r["file"], r["user"], r["words"]) for r in ingest.tokens(spark, target).collect()]
    assert sorted(rows) == [("a", "u", ["one", "two", "two"]), ("b", "v", ["two", "three"]), ("b", "w", ["four"])]
    assert [tuple(r) for r in ingest.dictionary(spark, target).orderBy("word_id").collect()] == [("two", 1, 3), ("four", 2, 1), ("one", 3, 1), ("three", 4, 1)]
    by_file = spark.read.parquet(f"{target}/counts").filter("word = 'two'").collect()
    assert {r["file"]: r["cnt"] for r in by_file} == {"a": 2, "b": 1}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batches") / "rows")
    spark.range(1000).repartition(3).write.option("maxRecordsPerFile", 150).parquet(path)
    return path


def test_batches_rerun_alike_and_lose_nothing(spark, folder):
    first = [(r["batch"], r["row"], r["id"]) for r in mini_batches(spark, folder, 64, seed=1).orderBy("row").collect()]
    assert sorted(x[2] for x in first) == list(range(1000)) and [x[1] for x in first] == list(range(1000))
    assert Counter(x[0] for x in first) == Counter({k: 64 if k < 15 else 40 for k in range(16)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        again = [(r["batch"], r["row"], r["id"]) for r in mini_batches(spark, folder, 64, seed=1).orderBy("row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == first
    other = [r["id"] for r in mini_batches(spark, folder, 64, seed=2).orderBy("row").collect()]
    assert other != [x[2] for x in first] and sorted(other) == list(range(1000))


def test_a_range_of_files_and_going_on(spark, folder):
    whole = {r["id"] for k in range(0, 9, 3) for r in mini_batches(spark, folder, 50, first=k, last=k + 3).collect()}
    assert whole == set(range(1000))
    part = mini_batches(spark, folder, 50, first=1, last=3)
    assert 0 < part.count() <= 300
    batches = {k: [r["id"] for r in rows.collect()] for k, rows in each_batch(part)}
    assert {k: [r["id"] for r in rows.collect()] for k, rows in each_batch(part, first=2)} == {k: v for k, v in batches.items() if k >= 2}
    assert all(len(v) == 50 for v in list(batches.values())[:-1])


def test_no_shuffle_of_rows_and_clashing_names(spark, folder, tmp_path):
    plan = mini_batches(spark, folder, 64)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    path = str(tmp_path / "x")
    spark.range(3).withColumnRenamed("id", "batch").write.parquet(path)
    with pytest.raises(ValueError, match="batch"):
        mini_batches(spark, path, 2)
    spark.range(0).write.parquet(str(tmp_path / "none"))
    none = mini_batches(spark, str(tmp_path / "none"), 2)
    assert none.count() == 0 and list(each_batch(none)) == []
