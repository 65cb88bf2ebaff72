"""Files in, files out, and streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import moodspace as MS
from textloom.operators import vocabulary as V
from textloom.sources import files, posts
from textloom.streaming import moods as stream

ONE = """<posts><post><user>u1</user><itemid><int>3</int></itemid>
  <event><string>hi &lt;b&gt;x&lt;/b&gt; there :-) . yes!</string></event>
  <event_timestamp><int>1136720880</int></event_timestamp><current_moodid><int>5</int></current_moodid></post>
  <post><user>u1</user><event><base64>abc</base64></event></post></posts>"""
TWO = """<posts><post><user>u2</user><event><string>two</string></event><current_moodid><int>5</int></current_moodid>
  <current_moodid><int>6</int></current_moodid></post>
  <post><user>u2</user><event><string>own</string></event><current_mood><string>odd</string></current_mood></post></posts>"""


@pytest.fixture
def xml(tmp_path):
    (tmp_path / "u1.xml").write_text(ONE)
    (tmp_path / "u2.xml").write_text('<?xml version="1.0"?>' + TWO)
    return str(tmp_path)


def test_xml_posts(spark, xml):
    rows = posts.read_posts(spark, xml).orderBy("file", "pos").collect()
    assert [(r["file"], r["user"], r["item_id"], r["mood_id"], r["custom_mood"]) for r in rows] == [
        ("u1", "u1", 3, 5, None), ("u1", "u1", None, None, None), ("u2", "u2", None, None, None), ("u2", "u2", None, None, "odd"),
    ]
    assert [r["text"] for r in rows] == ["hi x there :-) . yes!", None, "two", "own"]
    assert [r["user"] for r in posts.user_names(spark, xml).orderBy("user_id").collect()] == ["u1", "u2"]


@pytest.mark.parametrize("between", ["", "\n", '<?xml version="1.0"?>'])
def test_files_of_several_documents(spark, tmp_path, between):
    (tmp_path / "both.xml").write_text(between.lstrip() + ONE + between + TWO)
    assert [r["text"] for r in posts.read_posts(spark, str(tmp_path)).orderBy("user", "pos").collect()] == ["hi x there :-) . yes!", None, "two", "own"]
    one = "<posts><post><user>{}</user><event><string>x</string></event></post></posts>"
    (tmp_path / "both.xml").write_text(one.format("u") + between + one.format("v"))
    assert sorted(r["user"] for r in posts.read_posts_strict(spark, str(tmp_path)).collect()) == ["u", "v"]


def test_strict_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<posts><post><user>u</user><event><string>&lt;b&gt;x&lt;/b&gt;</string></event></post></posts>")
    assert [tuple(r) for r in posts.read_posts_strict(spark, str(tmp_path)).collect()] == [("u", "x")]
    (tmp_path / "b.xml").write_text("<posts><post><user>u</user><user>v</user><event><string>x</string></event></post></posts>")
    with pytest.raises(PySparkException):
        posts.read_posts_strict(spark, str(tmp_path)).collect()


def test_posts_in_spans(spark):
    users = spark.createDataFrame([("f", 0, 9, "a"), ("f", 20, 2_500_000, "b"), ("g", 5, 6, "c")], "file string, start long, stop long, user string")
    own = spark.createDataFrame([(1, "f", 0), (2, "f", 9), (3, "f", 10), (4, "f", 2_400_000), (5, "g", 4)], "id long, file string, start long")
    assert {r["id"]: r["user"] for r in posts.locate_posts(own, users).collect()} == {1: "a", 2: "a", 3: None, 4: "b", 5: None}


def test_mood_files(spark, tmp_path):
    whole = tmp_path / "moods.csv"
    whole.write_text("id,mood,level,parent id,parent\r1,angry,1,,\r2,cross,2,1,angry\r")
    rows = files.read_moods(spark, str(whole)).collect()
    assert [(r["mood_id"], r["mood"], r["level"], r["parent_id"]) for r in rows] == [
        (0, "empty", None, None), (1, "angry", 1, None), (2, "cross", 2, 1), (50, "invalid", None, None), (94, "invalid2", None, None),
    ]
    bare = tmp_path / "bare.csv"
    bare.write_text("1,angry\r2,cross\r")
    assert {(r[0], r[1]) for r in files.read_moods(spark, str(bare), header=False).collect()} == {(1, "angry"), (2, "cross"), (-1, "N/A")}


def test_vectors_and_words_as_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nun 1 2.5 -3\ndeux 0 0 1e-2\n")
    vectors = files.read_word_vectors(spark, str(tmp_path / "v.txt"))
    assert {r["word"]: r["vector"] for r in vectors.collect()} == {"un": [1.0, 2.5, -3.0], "deux": [0.0, 0.0, 0.01]}
    files.write_word_vectors(vectors, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_word_vectors(spark, str(tmp_path / "out")).select("word").collect())) == [("deux",), ("un",)]
    words = V.number(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, cnt long"), most=10)
    assert files.words_line(words).first()["value"] == "c a b"
    files.write_words(words, str(tmp_path / "words"))
    assert spark.read.text(str(tmp_path / "words")).count() == 3
    files.write_metrics(words, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 3


def test_sentences_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(["x", "y"], "7"), ([], "8")], "words array<string>, user string")
    files.write_sentences(rows, str(tmp_path / "s"), user="user")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["USER_7 x USER_7 y USER_7", "USER_8 USER_8"]


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.createDataFrame([(f"2024-01-0{d} 10:00:00", m) for d, m in ((1, "a"), (1, "a"), (2, "b"), (9, "a"))], "ts string, event_type string")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(source)
    live = spark.readStream.schema(events.schema).parquet(source)
    stream.write_counts(stream.mood_windows(live), out, str(tmp_path / "mark")).awaitTermination()
    got = {(r["mood"], r["n"]) for r in spark.read.parquet(out).collect()}
    # The last window stays open until the watermark passes it.
    assert got == {("a", 2), ("b", 1)}
    assert stream.mood_windows(events).count() == 3


def test_streamed_vocabulary(spark, tmp_path):
    texts = spark.createDataFrame([("a b a",), ("b. c",)], "text string")
    texts.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    stream.write_counts(stream.word_counts(live), str(tmp_path / "out"), str(tmp_path / "mark"), "complete").awaitTermination()
    got = {r["word"]: r["cnt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["word"]: r["cnt"] for r in V.count_words(texts.select(T.words("text").alias("words"))).collect()}


def test_components_find_independent_signals(spark):
    rows = spark.range(4000).select(
        (F.rand(1) * 2 - 1).alias("s"), (F.signum(F.rand(2) - 0.5) * (F.rand(3) + 0.5)).alias("t"),
    ).select((F.col("s") + 0.5 * F.col("t")).alias("a"), (F.col("s") - F.col("t")).alias("b"), "s", "t").persist()
    white, w = MS.whiten(rows, ["a", "b"])
    unmixing = MS.ica(white, ["w0", "w1"])
    u = [sum(F.col(f"w{j}") * float(unmixing[i, j]) for j in range(2)) for i in range(2)]
    got = white.select(*(F.abs(F.corr(u[i], F.col(x))).alias(f"{i}{x}") for i in range(2) for x in "st")).first().asDict()
    assert max(got["0s"], got["1s"]) > 0.95
    assert max(got["0t"], got["1t"]) > 0.95
    assert (MS.signal_energy(white, ["w0", "w1"], unmixing, w) > 0).all()
