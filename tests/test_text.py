"""Lexical rules, sentences and dictionaries on hand-worked cases."""

import pytest
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import features as X
from textloom.operators import moods as M
from textloom.operators import sentences as S
from textloom.operators import vocabulary as V

TOKENS = [
    ("Hi there :-) I'm 25. I <3 it!! see http://x.org", "Hi|there|:-)|I|m|25.|I|<3|it|!|!|see|http://|x|.|org"),
    ("! wow. so...... tired", "!|wow|.|so|......|tired"),
    ("my neighbor's house ;) >:P", "my|neighbor|s|house|;)|:P"),
    ("D: no way =( ok :o) :'( ^_^ ]-: 8)", "D:|no|way|=(|ok|:o)|:'(|^_^|]-:|8)"),
    ("café naïve -12 3.5", "caf|na|ve|-12|3.5"),
    ("", ""),
    (None, ""),
]


def _words(spark, rows):
    return spark.createDataFrame([(i, r.split()) for i, r in enumerate(rows)], "post_id long, words array<string>")


def test_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i long, text string")
    got = {r["i"]: r["s"] for r in rows.select("i", F.array_join(T.raw_tokens("text"), "|").alias("s")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(TOKENS)}


def test_words_are_canonical_and_without_numbers(spark):
    rows = spark.createDataFrame([("So..... <333 <\\33 </3 12 OK",)], "text string")
    assert rows.select(T.words("text").alias("w")).first()["w"] == ["so", "...", "<3", "</3", "</3", "ok"]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("hi <b>x</b> there", "hi x there"),
        ('a <a href="u">link</a><!-- note -->.', "a link."),
        ("<o:p></o:p>x&nbsp;y &quot;z&quot; <st1:place w>", "xy z "),
        ("<base64>abc</base64>rest", "rest"),
        ("1 < 2 and 3 > 2", "1  2"),  # what looks like a short tag is one
        ("1 < 2 and three is > 2", "1 < 2 and three is > 2"),
        (None, None),
    ],
)
def test_markup_goes(spark, text, clean):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(T.clean_markup("t").alias("c")).first()["c"] == clean


@pytest.mark.parametrize(
    ("words", "post", "stream"),
    [
        ("one . two ! ? three", ["one .", "two !", "?", "three"], ["one", "two", "three"]),
        ("! wow . so ... tired", ["! wow .", "so ... tired"], ["wow", "so", "tired"]),
        ("hello", ["hello"], ["hello"]),
        ("", [], []),
        ("! ! ?", ["! !", "?"], []),
    ],
)
def test_sentences(spark, words, post, stream):
    rows = _words(spark, [words])
    for mode, expected in (("post", post), ("stream", stream)):
        got = S.sentences(rows, mode).orderBy("sent").collect()
        assert [" ".join(r["words"]) for r in got] == expected
        assert [r["n_words"] for r in got] == [len(e.split()) for e in expected]


def test_empty_first_sentence(spark):
    rows = _words(spark, ["! wow . so"])
    assert [r["sent"] for r in S.sentences(rows).orderBy("sent").collect()] == [1, 2]
    kept = S.sentences(rows, keep_empty=True).orderBy("sent").collect()
    assert [(r["sent"], len(r["words"])) for r in kept] == [(0, 0), (1, 3), (2, 1)]


def test_long_sentence_is_shown_cut_but_counted_whole(spark):
    row = S.sentences(_words(spark, ["a " * 700]), most=500).first()
    assert (len(row["words"]), row["n_words"]) == (500, 700)


@pytest.mark.parametrize(("words", "marked"), [("", "U U"), ("x", "U x U"), ("x y", "U x U y U"), ("x y z", "U x U y z U")])
def test_inject_ids(spark, words, marked):
    row = _words(spark, [words]).select(T.inject_ids("words", F.lit("U")).alias("m")).first()
    assert " ".join(row["m"]) == marked


def test_numbers_spans_and_times(spark):
    row = spark.range(1).select(
        T.decode_number(F.lit(-12)).alias("a"), T.decode_number(F.lit(-2147483648 + 7)).alias("b"),
        T.iso_seconds(F.lit("2006-01-08T12:08:00+00:00")).alias("c"), T.iso_seconds(F.lit("no")).alias("d"),
        T.tag_spans(F.lit("<p>a</p><p>b</p>"), "p").alias("e"), T.tag_spans(F.lit("<p>a</p><p>"), "p").alias("f"),
        T.count_words(F.lit(" a  b\n")).alias("g"), T.count_words(F.lit("  ")).alias("h"),
    ).first()
    assert tuple(row) == (-12, 7, 1136722080, None, ["a", "b"], None, 2, 0)


def test_merge_and_threshold(spark):
    a = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "word string, cnt long")
    b = spark.createDataFrame([("a", 1), ("c", 1), ("d", 1)], "word string, cnt long")
    got = V.from_counts(V.merge(a, b), most=2).orderBy("word_id").collect()
    assert [(r["word"], r["word_id"], r["cnt"]) for r in got] == [("a", 1, 6), ("c", 2, 3)]
    swapped = V.from_counts(V.merge(b, a), most=2).orderBy("word_id").collect()
    assert swapped == got
    assert V.from_counts(V.merge(a, b), most=1).count() == 1
    assert V.from_counts(a.limit(0), most=5).count() == 0


def test_numbering_without_a_bound_is_the_same(spark):
    counts = spark.range(500).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 7).alias("cnt"))
    one = V.number(counts, most=1000).orderBy("word_id").collect()
    many = V.number(counts).orderBy("word_id").collect()
    assert one == many
    assert [r["word_id"] for r in many] == list(range(1, 501))


def test_histogram_stats(spark):
    h = spark.createDataFrame([(1, 5), (2, 3), (10, 2)], "length long, n long")
    row = X.histogram_stats(h).first()
    assert (row["mean"], row["median"], row["mode"], row["rows"]) == (3.1, 2, 1, 10)


def test_mood_groups():
    assert [M.group_of(m) for m in (62, 19, 2, 85, 122)] == [1, 6, 7, 4, 0]
    assert [M.group_of(m, cascade=True) for m in (62, 19, 2, 85, 122)] == [10, 14, 9, 10, 0]
    assert len({m for g in M.GROUPS for m in g}) == 132


def test_moods(spark):
    ids = spark.createDataFrame([(m,) for m in (0, 1, 50, 94, 134, 135, None)], "m int")
    assert [r["v"] for r in ids.select(X.valid_mood(F.col("m")).alias("v")).collect()] == [False, True, False, False, True, False, False]
    some = spark.createDataFrame([(1, "a"), (50, "kept")], "mood_id int, mood string")
    assert {(r["mood_id"], r["mood"]) for r in M.complete(some).collect()} == {(0, "empty"), (1, "a"), (50, "kept"), (94, "invalid2")}
