"""Queries on embeddings, semantic and keyword search, weights, metrics, learners and the mood map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.columns import sample_share
from textloom.operators import embedding as E
from textloom.operators import features as X
from textloom.operators import keyword as K
from textloom.operators import learners as L
from textloom.operators import metrics as MX
from textloom.operators import moodspace as MS
from textloom.operators import postings as P
from textloom.operators import saved_searches as SV
from textloom.operators import semantic as Q
from textloom.operators import sentences as S
from textloom.operators import skip_gram as SG
from textloom.operators import sparse_learner as SL
from textloom.operators import vector_index as VI
from textloom.operators import vocabulary as V
from textloom.operators import weighting as W
from textloom.session import cut_lineage, stored
from textloom.sources.files import spread, table

from .registry import ORACLES, SENTENCE_VECTORS, TOK, VECTORS, labelled, posts, query, vocabulary_sql
from .text_queries import MOODS

DIM = 64
FLAGSHIP = "the [2] and"
#: Queries of one sentence, of several summed into one vector, and with weights.
BATCH = ("the [2] and", ("the", "of [3] and"), "in [-1] to the")


def word_vectors(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """(word, vector) of the words with word_id = vec_id + 1, written once: as many as embeddings has ids are numbered."""
    own = posts(spark, sf_dir) if own is None else own
    given = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("word_id"), F.col("embedding").alias("vector"))
    most = given.agg(F.max("word_id")).first()[0] or 0
    return cut_lineage(V.first_words(own, most).join(given, "word_id").select("word", "vector"))


def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences(posts(spark, sf_dir))


def _weights_sql(terms: list[tuple[int, str, float]]) -> str:
    return ", ".join(f"({k}, '{w}', {x!r})" for k, w, x in terms)


_TERMS = _weights_sql([(0, "the", 2.0), (0, "and", 1.0), (1, "the", 1.0), (1, "of", 3.0), (1, "and", 1.0), (2, "in", -1.0), (2, "to", 1.0), (2, "the", 1.0)])
_SCORED = SENTENCE_VECTORS + f""", terms AS (SELECT * FROM (VALUES {_TERMS}) AS t(query_id, word, weight)
), qv AS (
  SELECT query_id, d, sum(weight * v) AS v FROM (SELECT query_id, weight, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS d FROM terms JOIN wv USING (word)) GROUP BY query_id, d
), qn AS (
  SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY query_id
), dots AS (
  SELECT post_id, sent, query_id, sum(sv.v * qv.v) AS p FROM sv JOIN qv USING (d) GROUP BY ALL
), scored AS (
  SELECT s.post_id, s.sent, s.n_words, s.words, d.query_id, round(p / sn.n / qn.n, 6) AS score
  FROM dots d JOIN sn USING (post_id, sent) JOIN qn USING (query_id) JOIN sents s ON s.post_id = d.post_id AND s.sent = d.sent WHERE sn.n > 0
)"""


def _top_sql(where: str, k: int, dedupe: str = "post") -> str:
    test = f"WHERE {where}" if where else ""
    first, last = (test, "") if dedupe == "post" else ("", test)
    return f""", firsts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, score ORDER BY post_id, sent) AS f FROM scored {first}
), kept AS (
  SELECT * FROM (SELECT * FROM firsts WHERE f = 1) {last}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, post_id, sent) AS rank FROM kept)
SELECT query_id, rank, post_id, sent, n_words, score, array_to_string(words, ' ') AS sentence FROM ranked WHERE rank <= {k}"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "post_id", "sent", "n_words", "score", F.array_join("words", " ").alias("sentence"))


def _search(spark: SparkSession, sf_dir: str, queries, k: int, **options) -> DataFrame:
    vectors = options.pop("vectors", None)
    vectors = word_vectors(spark, sf_dir) if vectors is None else vectors
    rows = sentence_table(spark, sf_dir).select("post_id", "sent", "words", "n_words")
    return _shown(Q.search(rows, vectors, queries, k, **options))


@query(_SCORED + _top_sql("query_id = 0 AND n_words >= 15", 20))
def q03_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: 20 sentences of at least 15 words nearest to a weighted query, equal scores once."""
    return _search(spark, sf_dir, [FLAGSHIP], 20)


@query(_SCORED + _top_sql("query_id = 0 AND n_words >= 15 AND NOT contains(array_to_string(words, ' '), 'on')", 20, "pre"))
def q03_dedupe_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected sentence hides its equals; sentences with a substring are rejected."""
    return _search(spark, sf_dir, [FLAGSHIP], 20, exclude="on", dedupe="pre")


@query(_SCORED + _top_sql("n_words >= 15", 100))
def q05_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, list(BATCH), 100)


@query(_SCORED + _top_sql("n_words >= 15", 100))
def q05_stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored vectors: rows that can't be among the best are told by their bounds and not read or not scored."""
    vectors = word_vectors(spark, sf_dir)
    rows = E.sentence_vectors(sentence_table(spark, sf_dir).select("post_id", "sent", "words", "n_words"), vectors)
    return _shown(VI.search_index(VI.build_index(rows), spark, vectors, list(BATCH), 100).hits)


@query(_SCORED + _top_sql("n_words >= 15 AND NOT regexp_matches(array_to_string(words, ' '), ' (a|to) ')", 50))
def p07_exclude_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, list(BATCH), 50, exclude=" (a|to) ", how="regex")


@query(_SCORED + _top_sql("n_words >= 7 AND NOT list_has_any(words, ['on', 'at'])", 50))
def p07_exclude_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, list(BATCH), 50, min_words=7, exclude="on at", how="words")


@query(_SCORED + _top_sql("query_id = 0", 30))
def q08_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No least length and no filter; compiled expressions in place of Arrow batches."""
    return _search(spark, sf_dir, [FLAGSHIP], 30, min_words=0, method="columns")


@query(_SCORED.replace("FROM documents", "FROM documents WHERE doc_id % 10 < 3", 1) + _top_sql("query_id = 0", 20))
def q04_query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a reproducible three tenths of the posts, with their own vocabulary."""
    own = posts(spark, sf_dir).filter(F.col("post_id") % 10 < 3)
    vectors = word_vectors(spark, sf_dir, own)
    rows = S.sentences(own).select("post_id", "sent", "words", "n_words")
    return _shown(Q.search(rows, vectors, [FLAGSHIP], 20, min_words=0))


@query(_SCORED + ", one AS (SELECT 0 AS query_id, post_id, sent, n_words, words, score FROM scored WHERE query_id = 0 AND n_words >= 15 AND post_id % 2 = 0" + """
), two AS (SELECT 0 AS query_id, post_id, sent, n_words, words, score FROM scored WHERE query_id = 0 AND n_words >= 15 AND post_id % 2 = 1
), f AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY post_id, sent) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, post_id, sent) AS rank FROM f WHERE f = 1)
SELECT query_id, rank, post_id, sent, n_words, score, array_to_string(words, ' ') AS sentence FROM r WHERE rank <= 40""")
def q06_merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of two halves of the corpus, merged: the same as of the whole."""
    vectors = word_vectors(spark, sf_dir)
    rows = sentence_table(spark, sf_dir).select("post_id", "sent", "words", "n_words")
    parts = [Q.search(rows.filter(F.col("post_id") % 2 == k), vectors, [FLAGSHIP], 40) for k in range(2)]
    return _shown(Q.merge_results(parts[0].unionByName(parts[1]), 40))


@query(_SCORED + """, t AS (SELECT post_id, sent, round(sum(p / sn.n / qn.n), 6) AS score FROM dots d JOIN sn USING (post_id, sent) JOIN qn USING (query_id) WHERE sn.n > 0 GROUP BY ALL
), a AS (SELECT s.post_id, s.sent, s.n_words, s.words, coalesce(score, 0.0) AS score FROM sents s LEFT JOIN t ON s.post_id = t.post_id AND s.sent = t.sent
), f AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY post_id, sent) AS f FROM a
), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, post_id, sent) - 5 AS rank FROM f WHERE f = 1)
SELECT rank, post_id, sent, n_words, score, array_to_string(words, ' ') AS sentence FROM r WHERE rank BETWEEN 1 AND 25""")
def q07_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the scores of three queries, equal sums once; the first five rows are left out."""
    vectors = word_vectors(spark, sf_dir)
    rows = sentence_table(spark, sf_dir).select("post_id", "sent", "words", "n_words")
    hits = Q.multi_query(rows, vectors, list(BATCH), 25, ignore=5)
    return hits.select("rank", "post_id", "sent", "n_words", "score", F.array_join("words", " ").alias("sentence"))


_UNIT = _SCORED.replace(
    "wv AS (SELECT word, embedding FROM vocab JOIN embeddings ON word_id = vec_id + 1)",
    "wv AS (SELECT word, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS embedding FROM vocab JOIN embeddings ON word_id = vec_id + 1)",
)


@query(_UNIT + _top_sql("query_id = 0 AND n_words >= 15", 20))
def q13_unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word vector is divided by its length first."""
    return _search(spark, sf_dir, [FLAGSHIP], 20, vectors=E.unit_words(word_vectors(spark, sf_dir)))


@query(_SCORED.replace("ON word_id = vec_id + 1)", "ON word_id = vec_id + 1 WHERE word NOT IN ('a', 'in', 'with'))", 1) + _top_sql("query_id = 0 AND n_words >= 15", 20))
def e03_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, [FLAGSHIP], 20, vectors=E.without_stop_words(word_vectors(spark, sf_dir), ["a", "in", "with"]))


@query(f"SELECT CAST(query_id AS BIGINT) AS query_id, word, CAST(weight AS DOUBLE) AS weight FROM (VALUES {_TERMS}) AS t(query_id, word, weight)")
def q01_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.query_terms(spark, BATCH)


@query(VECTORS + f", terms AS (SELECT * FROM (VALUES {_TERMS}, (3, 'yo-yo', 1.0), (3, 'the', 1.0)) AS t(query_id, word, weight)) SELECT CAST(query_id AS BIGINT) AS query_id, word FROM terms WHERE word NOT IN (SELECT word FROM wv)")
def q02_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unknown_terms(Q.query_terms(spark, [*BATCH, "yo-yo the"]), word_vectors(spark, sf_dir))


@query(_SCORED + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(d AS BIGINT) AS d, round(v / n, 6) AS v FROM qv JOIN qn USING (query_id)")
def q02_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = Q.query_vectors(Q.query_terms(spark, BATCH), word_vectors(spark, sf_dir))
    rows = [(k, d, float(v)) for k, u in units.items() for d, v in enumerate(u)]
    return spark.createDataFrame(rows, "query_id long, d long, v double").withColumn("v", F.round("v", 6))


@query(SENTENCE_VECTORS + " SELECT post_id, sent, " + ", ".join(f"round(max(sv.v) FILTER (d = {i}) / any_value(n), 6) AS v{i}" for i in (0, 31, 63)) + " FROM sv JOIN sn USING (post_id, sent) WHERE n > 0 GROUP BY ALL")
def e04_sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.sentence_vectors(sentence_table(spark, sf_dir).select("post_id", "sent", "words"), word_vectors(spark, sf_dir))
    return rows.filter("vector IS NOT NULL").select("post_id", "sent", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 31, 63)))


@query(SENTENCE_VECTORS + " SELECT post_id, sent, " + ", ".join(f"round(max(sv.v) FILTER (d = {i}) / any_value(n), 6) AS v{i}" for i in (0, 31, 63)) + " FROM sv JOIN sn USING (post_id, sent) WHERE n > 0 GROUP BY ALL")
def e04_mapped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the vectors in files that tasks map, as for matrices over the broadcast's limit."""
    rows = E.sentence_vectors(sentence_table(spark, sf_dir).select("post_id", "sent", "words"), word_vectors(spark, sf_dir), method="store")
    return rows.filter("vector IS NOT NULL").select("post_id", "sent", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 31, 63)))


@query(SENTENCE_VECTORS + " SELECT post_id, sent, " + ", ".join(f"round(max(sv.v) FILTER (d = {i}) / any_value(n), 6) AS v{i}" for i in (0, 31, 63)) + " FROM sv JOIN sn USING (post_id, sent) WHERE n > 0 GROUP BY ALL")
def j03_bag_times_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins."""
    rows = E.sentence_vectors(sentence_table(spark, sf_dir).select("post_id", "sent", "words"), word_vectors(spark, sf_dir), method="join")
    return rows.filter("vector IS NOT NULL").select("post_id", "sent", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in (0, 31, 63)))


@query(VECTORS + " SELECT vocab.word, word_id, round(coalesce(embedding[1]::DOUBLE, 0.0), 6) AS v0, embedding IS NOT NULL AS known FROM vocab LEFT JOIN wv ON vocab.word = wv.word")
def j02_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = E.align(V.build(posts(spark, sf_dir)), word_vectors(spark, sf_dir), DIM)
    known = F.exists("vector", lambda x: x != 0)
    return aligned.select("word", "word_id", F.round(F.col("vector")[0], 6).alias("v0"), known.alias("known"))


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS peak FROM embeddings")
def a14_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max("embedding").cast("double"), 6).alias("peak"))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))
  / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT a AS query_id, b AS vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p) WHERE rank <= 10""")
def o03_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all: the ten nearest of each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return Q.nearest(rows.filter("vec_id % 100 = 0"), rows, 10, "vec_id")


@query("SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 10 AS rank FROM documents) WHERE rank BETWEEN 1 AND 20")
def o07_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.lit(0).alias("query_id"), "doc_id", F.lit(0).alias("n_words"), F.col("n_chars").cast("double").alias("score"))
    hits = Q.top_scores(rows, 20, ["doc_id"], dedupe=None, offset=10)
    return hits.select("doc_id", F.col("score").cast("long").alias("n_chars"), "rank")


@query("SELECT doc_id FROM documents WHERE (doc_id * 2654435761) % 1000 < 100")
def o09_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter((F.col("doc_id") * 2654435761) % 1000 < 100).select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def o10_batch_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 posts of each user; each task keeps only these before the shuffle."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", first.alias("k")).filter("k <= 20").select("source", "doc_id")


# Weights and splits


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT word, word_id FROM vocab WHERE word_id <= 50")
def w01_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top(V.build(posts(spark, sf_dir)), 50).select("word", "word_id")


@query("SELECT event_id, " + ", ".join(f"(event_type = '{m}')::INT AS \"y_{m}\"" for m in MOODS) + " FROM events")
def w02_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.one_hot(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", list(MOODS)).drop("event_type")


_TARGETS = (("click", "use", 1.0), ("view", "use", 0.5), ("view", "read", 0.5), ("purchase", "buy", 1.0))


@query(f"SELECT event_id, target, weight FROM events JOIN (VALUES {', '.join(map(str, _TARGETS))}) AS g(event_type, target, weight) USING (event_type)")
def w03_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame(list(_TARGETS), "mood string, target string, weight double")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("mood"))
    return W.regroup(rows, groups).select("event_id", "target", "weight")


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= ceil(count(*) OVER (PARTITION BY source) * 0.25) AS test FROM documents""")
def w04_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.split(table(spark, sf_dir, "documents").select("doc_id", "source"), 0.25, "source", "doc_id")


@query("WITH " + TOK + " SELECT post_id, w AS word, round(sqrt(count(*)), 6) AS weight FROM tok GROUP BY ALL")
def w05_square_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of every post's words."""
    return W.square_root(X.bag_of_words(posts(spark, sf_dir), ["post_id"], one_row=True)).select("post_id", "word", F.round("weight", 6).alias("weight"))


@query("WITH " + TOK + """, bow AS (SELECT post_id, w AS word, count(*) AS cnt FROM tok GROUP BY ALL), n AS (SELECT count(DISTINCT post_id) AS n FROM bow WHERE post_id % 4 <> 0),
idf AS (SELECT word, ln(any_value(n.n)::DOUBLE) - ln(count(*)::DOUBLE) AS idf FROM bow, n WHERE post_id % 4 <> 0 GROUP BY word)
SELECT post_id, word, round(cnt * coalesce(idf, 0.0), 6) AS weight FROM bow LEFT JOIN idf USING (word)""")
def w06_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training posts (id not divisible by four) give the idf; all posts are weighted. Posts are tokenised once."""
    bags = stored(posts(spark, sf_dir).select("post_id", X.bag("words").alias("bag")), "bags")
    train = F.col("post_id") % 4 != 0
    n, bow = bags.filter(train & (F.size("bag") > 0)).count(), bags.select("post_id", F.inline("bag"))
    return W.tfidf(bow, W.inverse_frequency(bow.filter(train), n)).select("post_id", "word", F.round("weight", 6).alias("weight"))


# Keyword search

_WOR = K.part("wor", prefix=True)
SEARCHES = (
    [K.part("time")],
    [K.part("time year")],
    [_WOR],
    [K.part("wor", "must", prefix=True), K.part("time", "not")],
    [K.part("src1", field="user", prefix=True), K.part("time")],
    [K.part("the", "must"), K.part("time", "must")],
)


def search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return K.analysed(docs.select(F.col("doc_id").alias("post_id"), F.col("text").alias("ptext"), F.col("source").alias("user")))


_STOPS = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of', 'on', 'or',
'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with'"""


@query(rf"""SELECT doc_id AS post_id, CAST(len(t) AS BIGINT) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})) AS t FROM documents)""")
def k01_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), K.analyse("text").alias("t"))
    return rows.select("post_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


_TERM_RANK = rf"""WITH p AS (SELECT doc_id AS post_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})) AS t FROM documents
), c AS (SELECT post_id, len(t) AS n, len(list_filter(t, lambda x: x = 'time')) AS a, len(list_filter(t, lambda x: starts_with(x, 'wor'))) AS b FROM p
), d AS (SELECT count(*)::DOUBLE AS docs, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c
), s AS (SELECT 0 AS query_id, post_id, sqrt(a::DOUBLE) * pow(1 + ln(docs / (da + 1)), 2) / sqrt(greatest(n, 1)::DOUBLE) AS score FROM c, d WHERE a > 0
  UNION ALL SELECT 1, post_id, (sqrt(a::DOUBLE) * pow(1 + ln(docs / (da + 1)), 2) + sqrt(b::DOUBLE) * pow(1 + ln(docs / (db + 1)), 2)) / sqrt(greatest(n, 1)::DOUBLE) FROM c, d WHERE a > 0 OR b > 0
  UNION ALL SELECT 2, post_id, sqrt(b::DOUBLE) * pow(1 + ln(docs / (db + 1)), 2) / sqrt(greatest(n, 1)::DOUBLE) FROM c, d WHERE b > 0 AND a = 0
)
SELECT CAST(query_id AS BIGINT) AS query_id, post_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, post_id) AS rank FROM s) WHERE rank <= 10"""


@query(_TERM_RANK)
def k03_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = K.search_batch(search_table(spark, sf_dir), [SEARCHES[0], [K.part("time"), _WOR], SEARCHES[3]], 10)
    return hits.select("query_id", "post_id", "score", "rank")


@query(rf"""WITH p AS (SELECT doc_id AS post_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})) AS t,
  list_filter(regexp_extract_all(lower(coalesce(source, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})) AS u FROM documents
), c AS (SELECT post_id, len(t) AS n, len(u) AS m, len(list_filter(t, lambda x: x = 'time')) AS a, len(list_filter(t, lambda x: starts_with(x, 'wor'))) AS b,
  len(list_filter(u, lambda x: starts_with(x, 'src1'))) AS s, len(list_filter(range(1, len(t)), lambda i: t[i] = 'time' AND t[i + 1] = 'year')) AS f FROM p
), d AS (SELECT count(*)::DOUBLE AS docs, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (s > 0) AS ds, count(*) FILTER (f > 0) AS df FROM c
), w AS (SELECT *, sqrt(a::DOUBLE) * pow(1 + ln(docs / (da + 1)), 2) / sqrt(greatest(n, 1)::DOUBLE) AS wa, sqrt(b::DOUBLE) * pow(1 + ln(docs / (db + 1)), 2) / sqrt(greatest(n, 1)::DOUBLE) AS wb,
  sqrt(s::DOUBLE) * pow(1 + ln(docs / (ds + 1)), 2) / sqrt(greatest(m, 1)::DOUBLE) AS ws, sqrt(f::DOUBLE) * pow(1 + ln(docs / (df + 1)), 2) / sqrt(greatest(n, 1)::DOUBLE) AS wf FROM c, d
), h AS (SELECT 0 AS query_id, post_id, wa AS score FROM w WHERE a > 0 UNION ALL SELECT 1, post_id, wf FROM w WHERE f > 0 UNION ALL SELECT 2, post_id, wb FROM w WHERE b > 0
  UNION ALL SELECT 3, post_id, wb FROM w WHERE b > 0 AND a = 0 UNION ALL SELECT 4, post_id, ws + wa FROM w WHERE s > 0 OR a > 0 UNION ALL SELECT 5, post_id, wa FROM w WHERE a > 0)
SELECT CAST(query_id AS BIGINT) AS query_id, post_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, post_id) AS rank FROM h) WHERE rank <= 10""")
def k02_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, phrases, prefixes, fields and signs; tests check such searches on hand-worked cases."""
    return K.search_batch(search_table(spark, sf_dir), list(SEARCHES), 10).select("query_id", "post_id", "score", "rank")


def search_index(spark: SparkSession, sf_dir: str) -> P.Index:
    return P.build_index(stored(search_table(spark, sf_dir).select("post_id", "tokens_ptext", "tokens_user"), "analysed"))


@query(_TERM_RANK)
def k03_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a positional index: built here, then only the blocks of the words are read."""
    hits = P.search_index(search_index(spark, sf_dir), spark, [SEARCHES[0], [K.part("time"), _WOR], SEARCHES[3]], 10)
    return hits.select("query_id", "post_id", "score", "rank")


@query(ORACLES["k02_search_batch"])
def k02_index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, phrases, prefixes, fields and signs, from the index."""
    return P.search_index(search_index(spark, sf_dir), spark, list(SEARCHES), 10)


@query(rf"""WITH b AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS}))[1:5]) AS term FROM benchmark
), a AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL
), p AS (SELECT doc_id AS post_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS})) AS t FROM documents
), t AS (SELECT post_id, len(t) AS n, unnest(t) AS term FROM p
), c AS (SELECT post_id, any_value(n) AS n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM a) GROUP BY post_id, term
), d AS (SELECT term, pow(1 + ln((SELECT count(*) FROM documents)::DOUBLE / (count(*) + 1)), 2) AS idf2 FROM c GROUP BY term
), s AS (SELECT item_id, post_id, round(sum(times * sqrt(tf::DOUBLE) * idf2 / sqrt(n::DOUBLE)), 6) AS score FROM a JOIN c USING (term) JOIN d USING (term) GROUP BY ALL)
SELECT item_id, post_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, post_id) AS rank FROM s) WHERE rank <= 10""")
def k04_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved search for each benchmark item (any of its first five words), all run in one pass over the posts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.slice(K.analyse("text"), 1, 5).alias("words")).orderBy("item_id").collect()  # the stated searches
    hits = SV.search_many(search_table(spark, sf_dir), [[K.part(w) for w in r["words"]] for r in items], 10)
    names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "query_id long, item_id long"))
    return hits.join(names, "query_id").select("item_id", "post_id", "score", "rank")


@query(rf"WITH t AS (SELECT doc_id AS post_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')) AS term FROM documents) SELECT term, post_id, count(*) AS tf FROM t WHERE term NOT IN ({_STOPS}) GROUP BY ALL")
def k03_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("ptext"))
    return K.postings(docs)


# Metrics, on a score that SQL can make too


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability and labels for each labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"), "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", ((F.col("n_chars") % 97) / F.lit(100.0)).alias("score"))
    return labels.join(docs, "doc_id")


_SCORES = 'WITH s AS (SELECT doc_id, source, quality::BIGINT AS label, toxic, (n_chars % 97) / 100.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))'


@query(_SCORES + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 6) AS auc FROM r""")
def m05_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.auc(_scored(spark, sf_dir)).select(F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"), "auc")


@query(_SCORES + """, b AS (SELECT CAST(least(floor(score * 100), 100) AS BIGINT) AS k, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1)
SELECT k, round((sum(p) OVER (ORDER BY k DESC))::DOUBLE / sum(p) OVER (), 6) AS tpr, round((sum(n) OVER (ORDER BY k DESC))::DOUBLE / sum(n) OVER (), 6) AS fpr FROM b""")
def m05_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.roc_curve(_scored(spark, sf_dir))


@query(_SCORES + """, a AS (SELECT *, label * score + (1 - label) * (1 - score) AS a FROM s)
SELECT toxic, round(avg(a), 6) AS accuracy, round((coalesce(avg(a) FILTER (label = 1), 0) + coalesce(avg(a) FILTER (label = 0), 0)) / count(DISTINCT label), 6) AS balanced, round(avg(ln(1e-7 + a)), 6) AS loglik FROM a GROUP BY toxic""")
def m07_soft_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and log-likelihood by class."""
    return MX.soft_accuracy(_scored(spark, sf_dir), ["toxic"])


@query(_SCORES + """, c AS (SELECT label, (score >= 0.5)::BIGINT AS predicted, count(*) AS n FROM s GROUP BY ALL) SELECT label, predicted, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c""")
def a11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("long"))
    return MX.confusion(rows)


@query(_SCORES + """, c AS (SELECT label, (score >= 0.5)::BIGINT AS predicted, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c)
SELECT round((sum(n) FILTER (label = predicted))::DOUBLE / sum(n), 6) AS weighted, round(sum(share) FILTER (label = predicted) / count(DISTINCT label), 6) AS mean_diagonal FROM d""")
def a11_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("long"))
    return MX.accuracy(MX.confusion(rows))


_BY_SOURCE = _SCORES + """, r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS r FROM s
), g AS (SELECT source, count(*) AS n, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label)::DOUBLE * sum(1 - label), 0), 6) AS auc FROM r GROUP BY source)"""


@query(_BY_SOURCE + " SELECT round(sum(auc * n) / sum(n), 6) AS auc, CAST(sum(n) AS BIGINT) AS n FROM g WHERE auc IS NOT NULL")
def a12_weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each source's rows, weighted by their number."""
    by = MX.auc(_scored(spark, sf_dir), ["source"]).withColumn("n", F.col("positives") + F.col("negatives")).filter("auc IS NOT NULL")
    return by.agg(F.round(MX.weighted_mean("auc", "n"), 6).alias("auc"), F.sum("n").cast("long").alias("n"))


@query(_BY_SOURCE + " SELECT (SELECT source FROM g WHERE auc IS NOT NULL ORDER BY auc DESC, source LIMIT 1) AS best, (SELECT source FROM g WHERE auc IS NOT NULL ORDER BY auc, source LIMIT 1) AS worst")
def m09_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = MX.auc(_scored(spark, sf_dir), ["source"]).filter("auc IS NOT NULL")
    return MX.best_and_worst(by, "source", "auc")


@query("SELECT user_id, event_type AS mood, round(max(value), 6) AS score FROM events GROUP BY ALL")
def a08_post_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "mood")
    return MX.post_scores(rows, ["user_id", "mood"], "value")


@query("""WITH m AS (SELECT user_id, max(value) AS score, (count(*) FILTER (event_type = 'purchase') > 0)::BIGINT AS label FROM events GROUP BY user_id), x AS (SELECT user_id, round(score, 6) AS score, label FROM m),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label)::DOUBLE * sum(1 - label), 0), 6) AS auc FROM r""")
def m08_post_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of scores that are maxima over the rows of a user."""
    events = table(spark, sf_dir, "events")
    labels = events.groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > 0).cast("long").alias("label"))
    return MX.auc(MX.post_scores(events, ["user_id"], "value").join(labels, "user_id")).select("auc")


_PAIRS = ("l_quantity", "l_discount", "l_tax")


def _pairs_sql(fn: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({fn}({a}, {b}), 6) AS value FROM lineitem" for a in _PAIRS for b in _PAIRS)


@query(_pairs_sql("covar_samp"))
def l01_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.covariance(table(spark, sf_dir, "lineitem"), _PAIRS)


@query(_pairs_sql("corr"))
def l02_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.covariance(table(spark, sf_dir, "lineitem"), _PAIRS, kind="corr")


@query(_pairs_sql("covar_pop"))
def l03_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MX.gram(table(spark, sf_dir, "lineitem"), _PAIRS)


# Learners and the mood map: iterative, so their results are checked by properties


@query()
def m01_one_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood"))
    train = F.col("post_id") % 4 != 0
    fitted = L.one_vs_all(rows.filter(train), [1, 2])
    return L.predict(fitted, rows.filter(~train)).select("post_id", "label", F.round("p_2", 6).alias("score"), "predicted")


@query()
def m02_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood") - 1)
    tuned = L.grid_search(rows)
    named = [{p.name: v for p, v in m.items()} for m in tuned.getEstimatorParamMaps()]
    cells = [(float(m["regParam"]), float(m["elasticNetParam"]), float(v)) for m, v in zip(named, tuned.validationMetrics, strict=True)]
    return spark.createDataFrame(cells, "reg double, l1 double, auc double")


@query()
def m04_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 most frequent words: with 75,000 the fit needs 2.6 GB of the driver, more than a default session has."""
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood") - 1)
    fitted = L.network(rows.filter(F.col("post_id") % 4 != 0), 2, n_words=5_000)
    return fitted.transform(rows.filter(F.col("post_id") % 4 == 0)).select("post_id", "label", "prediction")


@query()
def m01_joint_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All moods in one model, trained in one job a pass; tests compare its steps with numpy's."""
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood"))
    train = F.col("post_id") % 4 != 0
    model = SL.train(rows.filter(train), [1, 2], passes=10)
    return SL.predict(model, rows.filter(~train)).select("post_id", "label", F.round("p_2", 6).alias("score"), "predicted")


@query()
def m02_joint_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original's 18 grid points for each mood, trained together, and their areas over a held-out quarter."""
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood"))
    model = SL.train(rows.filter("post_id % 4 <> 0"), [1, 2], SL.GRID, passes=3, batches=2, binary=True)
    return SL.grid_scores(model, rows.filter("post_id % 4 = 0"))


@query()
def m04_sparse_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """75,000 words, 200 hidden units; no weight passes through the driver."""
    rows = labelled(spark, sf_dir).withColumn("label", F.col("mood"))
    model = SL.train(rows.filter("post_id % 4 <> 0"), [1, 2], (SL.Point(0.5, 0.4, 1e-4),), hidden=200, passes=3, batches=2)
    return SL.predict(model, rows.filter("post_id % 4 = 0")).select("post_id", "label", F.round("p_2", 6).alias("score"), "predicted")


@query()
def e01_word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.model_vectors(E.train_word2vec(posts(spark, sf_dir).select("words")))


@query()
def e01_skip_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram with negative sampling over the even posts, then taken up from its files over the odd ones; tests plant pairs."""
    own = stored(posts(spark, sf_dir).select("post_id", "words"), "posts")
    model = SG.train(SG.start(V.count_words(own)), own.filter("post_id % 2 = 0"))
    return SG.vectors(spark, SG.train(SG.load(model.folder), own.filter("post_id % 2 <> 0 OR post_id IS NULL")))


def _user_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = X.moods_per_user(table(spark, sf_dir, "events"), mood="event_type")
    return X.mood_table(counts, list(MOODS), mood="event_type")


@query()
def m10_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.nmf(_user_moods(spark, sf_dir), list(MOODS), rank=3)[0]


@query()
def m10_sparse_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.sfa(_user_moods(spark, sf_dir), list(MOODS), rank=3, passes=12)[0]


@query()
def m10_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(MOODS), outputCol="features").transform(_user_moods(spark, sf_dir))
    topics = MS.lda(ready, topics=3, passes=5).transform(ready)
    return topics.select("user_id", *(vector_to_array("topicDistribution")[i].alias(f"t{i}") for i in range(3)))


@query("SELECT 'w' || a AS x, 'w' || b AS y, (a = b)::INT::DOUBLE AS value FROM range(5) AS s(a), range(5) AS t(b)")
def m11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of whitened counts: the identity."""
    white, _ = MS.whiten(_user_moods(spark, sf_dir), list(MOODS))
    return MX.covariance(white, [f"w{i}" for i in range(len(MOODS))]).withColumn("value", F.round(F.abs("value"), 4))


@query()
def m14_mood_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MS.build_map(_user_moods(spark, sf_dir), list(MOODS), rank=3, passes=6)


@query(SENTENCE_VECTORS + """ SELECT s.post_id, s.sent, s.n_words FROM sents s JOIN sn USING (post_id, sent)
WHERE n > 0 AND ('0x' || substr(md5('94720:' || s.post_id), 1, 8))::BIGINT < 429496729""")
def e05_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hashed tenth of the posts, as sentence vectors to keep in memory. Others have no vectors made; their words are counted."""
    own = sentence_table(spark, sf_dir).select("post_id", "sent", "words", "n_words").filter(sample_share("post_id", 0.1))
    rows = E.sentence_vectors(own, word_vectors(spark, sf_dir))
    return E.load_sample(rows, 0.1).filter("vector IS NOT NULL").select("post_id", "sent", "n_words")
