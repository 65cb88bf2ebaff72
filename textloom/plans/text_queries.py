"""Queries on tokens, sentences, vocabularies and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import exploded
from textloom.operators import features as X
from textloom.operators import moods as M
from textloom.operators import sentences as S
from textloom.operators import vocabulary as V
from textloom.sources import files
from textloom.sources.files import spread, table
from textloom.sources.posts import locate_posts
from textloom.session import shared_folder
from textloom.streaming.moods import mood_windows

from .registry import BASE64_SQL, EMOTICON_SQL, MARKUP_SQL, POSTS, SENTS, TOK, TOKEN_SQL, VOCAB, canonical_sql, labelled, posts, query, sentences_sql, vocabulary_sql

# Lines that show each lexical rule.
LINES = (
    "Hi there :-) I'm 25. I <3 it!! see http://x.org", "! wow. so...... tired", "my neighbor's house ;) >:P",
    "D: no way =( ok :o) :'( ^_^ ]-: 8)", "caf -12 3.5 <333 </3 XD :D :-|| >:-<",
)
_LINES_SQL = ", ".join("('" + x.replace("'", "''") + "')" for x in LINES)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("text")
    return said.unionByName(spark.createDataFrame([(x,) for x in LINES], "text string"))


@query(rf"""SELECT page_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS clean_md5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(html, '{BASE64_SQL}', '', 'g'), '{MARKUP_SQL}', '', 'g') AS c FROM pages)""")
def t02_clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "pages").select("page_id", T.clean_markup("html").alias("c"))
    return clean.select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("clean_md5"))


@query(rf"""SELECT doc_id, CAST(len(n) AS BIGINT) AS n_numbers, list_sum(list_transform(n, lambda x: TRY_CAST(regexp_replace(x, '\.$', '') AS DOUBLE))) AS total FROM (
  SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'), lambda x: regexp_matches(x, '^-?[0-9]')) AS n FROM documents) WHERE len(n) > 0""")
def t08_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(T.tagged_tokens("text"), lambda x: x["kind"] == "num").alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda s, x: s + x["num"])
    return docs.filter(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("n_numbers"), total.alias("total"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS posted_at FROM events")
def t09_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return table(spark, sf_dir, "events").select("event_id", T.iso_seconds(written).alias("posted_at"))


@query("WITH " + POSTS + """ SELECT post_id, CAST(len(r) AS BIGINT) AS n_tokens, CAST(len(words) AS BIGINT) AS n_words, md5(array_to_string(words, ' ')) AS words_md5
FROM posts JOIN raw USING (post_id)""")
def t10_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select(F.col("doc_id").alias("post_id"), T.words("text").alias("w"), T.raw_tokens("text").alias("r"))
    return docs.select("post_id", F.size("r").cast("long").alias("n_tokens"), F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_SAID = f"""WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS x FROM (
  SELECT text FROM conversations UNION ALL SELECT * FROM (VALUES {_LINES_SQL}) AS v(text)))"""


def _kind_counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    tokens = exploded(_lines(spark, sf_dir), [], F.filter(T.tagged_tokens("text"), lambda x: x["kind"] == kind), "t")
    return tokens.groupBy(F.col("t.tok").alias("tok")).agg(F.count("*").alias("n"))


@query(f"{_SAID} SELECT {canonical_sql('x')} AS tok, count(*) AS n FROM t WHERE regexp_matches(x, '(?i)^(?:{EMOTICON_SQL}|XD)$') AND NOT regexp_matches(x, '^-?[0-9]') GROUP BY 1")
def t11_emoticons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind_counts(spark, sf_dir, "emoticon")


@query(rf"{_SAID} SELECT {canonical_sql('x')} AS tok, count(*) AS n FROM t WHERE regexp_matches(x, '^(?:[;:,.?!]|\.\.+)$') GROUP BY 1")
def t12_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind_counts(spark, sf_dir, "punct")


@query("SELECT CAST(count(*) AS BIGINT) AS n_lines FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) FROM documents)")
def t13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("n_lines"))


@query("WITH " + TOK + f" SELECT w AS word, count(*) AS cnt FROM tok WHERE regexp_matches(w, '(?i)^(?:{EMOTICON_SQL}|XD)$') GROUP BY w")
def t14_emoticon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.count_words(posts(spark, sf_dir)).filter(T.is_emoticon("word"))


@query("WITH c AS (SELECT event_id, (event_id * 1103515245) % 4294967296 - 2147483648 AS code FROM events) SELECT event_id, CASE WHEN code < -1073741824 THEN code + 2147483648 ELSE code END AS number FROM c")
def t17_decode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("event_id") * 1103515245) % 4294967296 - 2147483648
    return table(spark, sf_dir, "events").select("event_id", T.decode_number(code).alias("number"))


@query("""WITH p AS (SELECT page_id, len(regexp_extract_all(html, '<p>')) = len(regexp_extract_all(html, '</p>')) AS same, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS s FROM pages)
SELECT page_id, CASE WHEN same THEN CAST(len(s) AS BIGINT) END AS n_spans, CASE WHEN same THEN md5(array_to_string(s, '|')) END AS spans_md5 FROM p""")
def t18_tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "pages").select("page_id", T.tag_spans("html", "p").alias("s"))
    size = F.when(F.col("s").isNotNull(), F.size("s").cast("long"))
    return spans.select("page_id", size.alias("n_spans"), F.when(F.col("s").isNotNull(), F.md5(F.array_join("s", "|"))).alias("spans_md5"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS BIGINT) AS n_words FROM documents")
def t19_count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words("text").alias("n_words"))


@query("SELECT c_custkey, printf('%.3f -- %-100s -- %s', c_acctbal, c_name, 'http://' || c_name || '.example.org/') AS line FROM customer")
def t20_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.result_line("c_acctbal", "c_name", T.user_url("c_name")).alias("line"))


@query("SELECT DISTINCT source AS \"user\", 'http://' || source || '.example.org/' AS url FROM documents")
def t21_user_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("user")).distinct().withColumn("url", T.user_url("user"))


@query(SENTS + " SELECT CAST(least(n_words + CASE WHEN n_words >= 2 THEN 3 ELSE 2 END, 503) AS BIGINT) AS length, count(*) AS n FROM sents GROUP BY 1")
def t22_inject_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sentences(posts(spark, sf_dir))
    marked = rows.select(T.inject_ids("words", F.concat(F.lit("USER_"), "user")).alias("w"))
    return S.length_histogram(marked, F.size("w"), 503)


@query(SENTS + " SELECT post_id, sent, n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM sents")
def f02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sentences(posts(spark, sf_dir))
    return rows.select("post_id", "sent", "n_words", F.md5(F.array_join("words", " ")).alias("words_md5"))


@query("WITH " + TOK + """, s AS (
  SELECT *, sum((w IN ('.', '!', '?', '...'))::INT) OVER (PARTITION BY post_id ORDER BY pos) AS g FROM tok
), t AS (
  SELECT post_id, g, list(w ORDER BY pos) AS words, count(*) AS n_words FROM s WHERE w NOT IN ('.', '!', '?', '...') GROUP BY post_id, g
) SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY g) - 1 AS sent, n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM t""")
def f04_sentence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sentences(posts(spark, sf_dir), "stream")
    return rows.select("post_id", "sent", "n_words", F.md5(F.array_join("words", " ")).alias("words_md5"))


@query(SENTS + " SELECT least(n_words, 500) AS length, count(*) AS n FROM sents GROUP BY 1")
def a07_sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.length_histogram(S.sentences(posts(spark, sf_dir)))


@query(SENTS + """, h AS (SELECT least(n_words, 500) AS k, count(*) AS n FROM sents GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS total FROM h)
SELECT CAST(sum(n) AS BIGINT) AS rows, round(sum(k * n) / sum(n), 6) AS mean, min(k) FILTER (2 * upto > total) AS median, (SELECT k FROM h ORDER BY n DESC, k LIMIT 1) AS mode FROM c""")
def a09_histogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.histogram_stats(S.length_histogram(S.sentences(posts(spark, sf_dir))))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS upto FROM conversations")
def o05_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", upto.alias("upto"))


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT word, word_id, cnt FROM vocab")
def d04_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.build(posts(spark, sf_dir)).select("word", "word_id", "cnt")


@query("WITH " + TOK + " SELECT w AS word, count(*) AS cnt FROM tok GROUP BY w")
def d04_merge_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries of parts of the posts, counts added up."""
    own = posts(spark, sf_dir)
    parts = [V.count_words(own.filter(F.col("post_id") % 3 == k)) for k in range(3)]
    return V.merge(*parts).select("word", F.col("cnt").cast("long").alias("cnt"))


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT post_id, count(word_id) AS known, count(*) - count(word_id) AS unknown FROM tok LEFT JOIN vocab ON w = word GROUP BY post_id")
def d05_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = posts(spark, sf_dir)
    flat = exploded(own, ["post_id"], F.col("words"))
    coded = V.encode(flat, V.build(own), keep_unknown=True)
    return coded.groupBy("post_id").agg(F.count("word_id").alias("known"), F.count_if(F.col("word_id").isNull()).alias("unknown"))


@query("WITH " + TOK + " SELECT w AS word, count(*) AS cnt FROM tok GROUP BY w HAVING count(*) >= 5")
def d06_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.trim(V.count_words(posts(spark, sf_dir)), 5)


_GROUPS_SQL = "[" + ", ".join(str(list(g)) for g in M.GROUPS) + "]"


def _moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 140 - 2).alias("mood"))


@query(f"""WITH g AS (SELECT unnest({_GROUPS_SQL}) AS ms, unnest(range(15)) AS k), m AS (SELECT unnest(ms) AS mood, k FROM g), l AS (SELECT mood, max(k) AS k FROM m GROUP BY mood)
SELECT coalesce(k, e.mood) AS mood_group, count(*) AS n FROM (SELECT event_id % 140 - 2 AS mood FROM events) e LEFT JOIN l ON e.mood = l.mood WHERE e.mood BETWEEN 1 AND 134 AND e.mood NOT IN (50, 94) GROUP BY 1""")
def d02_mood_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.grouped(_moods(spark, sf_dir).filter(X.valid_mood(F.col("mood"))))
    return rows.groupBy("mood_group").agg(F.count("*").alias("n"))


@query(f"""SELECT list_reduce(list_prepend(mood, range(15)), lambda a, k: CASE WHEN list_contains({_GROUPS_SQL}[k + 1], a) THEN k ELSE a END) AS mood_group, count(*) AS n
FROM (SELECT event_id % 140 - 2 AS mood FROM events) WHERE mood BETWEEN 1 AND 134 AND mood NOT IN (50, 94) GROUP BY 1""")
def d02_mood_groups_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.grouped(_moods(spark, sf_dir).filter(X.valid_mood(F.col("mood"))), cascade=True)
    return rows.groupBy("mood_group").agg(F.count("*").alias("n"))


@query("SELECT mood BETWEEN 1 AND 134 AND mood NOT IN (50, 94) AS valid, count(*) AS n, count(DISTINCT mood) AS moods FROM (SELECT event_id % 140 - 2 AS mood FROM events) GROUP BY 1")
def p03_valid_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _moods(spark, sf_dir).groupBy(X.valid_mood(F.col("mood")).alias("valid"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("mood").alias("moods"))


@query("SELECT conv_id, min(k) AS mood FROM (SELECT conv_id, length(text) % 5 AS k FROM conversations WHERE role = 'user') GROUP BY conv_id HAVING count(*) = 1")
def p02_single_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").filter("role = 'user'")
    lists = said.groupBy("conv_id").agg(F.collect_list((F.length("text") % 5).cast("long")).alias("moods"))
    return lists.withColumn("mood", X.single_mood(F.col("moods"))).filter("mood IS NOT NULL").select("conv_id", "mood")


@query("WITH " + TOK + " SELECT post_id, lang, count(*) AS n_words FROM tok GROUP BY ALL HAVING count(*) >= 15")
def p05_long_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("post_id", "lang", F.size("words").cast("long").alias("n_words"))
    return rows.filter("n_words >= 15")


_LABELLED = "lab AS (SELECT doc_id AS post_id, quality + 1 AS mood FROM labels)"


@query("WITH " + TOK + ", " + _LABELLED + " SELECT post_id, w AS word, count(*) AS cnt FROM tok JOIN lab USING (post_id) GROUP BY post_id, w")
def f01_post_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.featurize_posts(labelled(spark, sf_dir))["bow"]


@query("WITH " + TOK + ", " + _LABELLED + ", " + vocabulary_sql() + """, known AS (
  SELECT post_id, "user", lang, w, row_number() OVER (PARTITION BY post_id ORDER BY pos) - 1 AS pos FROM tok JOIN lab USING (post_id) JOIN vocab ON w = word
), """ + sentences_sql("known") + " SELECT post_id, sent, n_words, md5(array_to_string(words[1:500], ' ')) AS words_md5 FROM sents")
def f02_known_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of labelled posts, split after words outside the vocabulary have gone."""
    vocabulary = V.build(posts(spark, sf_dir))
    rows = X.featurize_sentences(labelled(spark, sf_dir), vocabulary)
    return rows.select("post_id", "sent", "n_words", F.md5(F.array_join("words", " ")).alias("words_md5"))


@query("SELECT user_id, event_type AS mood, count(*) AS cnt FROM events GROUP BY ALL")
def f03_user_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.featurize_users(table(spark, sf_dir, "events"), mood="event_type")["counts"].withColumnRenamed("event_type", "mood")


@query("WITH " + POSTS + ", " + _LABELLED + " SELECT CAST(mood AS BIGINT) AS mood, count(*) AS n FROM posts JOIN lab USING (post_id) GROUP BY mood")
def a02_mood_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.featurize_posts(labelled(spark, sf_dir))["moods"].withColumn("mood", F.col("mood").cast("long"))


@query("WITH " + TOK + ", " + vocabulary_sql() + """, c AS (SELECT post_id, count(*) AS a, count(word) AS b FROM tok LEFT JOIN vocab ON w = word GROUP BY post_id)
SELECT 'before' AS stage, least(a, 100000) AS length, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'after', least(b, 100000), count(*) FROM c WHERE b > 0 GROUP BY ALL""")
def a03_post_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = posts(spark, sf_dir).filter(F.size("words") > 0)
    known = V.known_words(own, V.build(own))
    sized = lambda rows, stage: S.length_histogram(rows, F.size("words"), 100_000).select(F.lit(stage).alias("stage"), "length", "n")
    return sized(own, "before").unionByName(sized(known, "after"))


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT word_id, any_value(word) AS word, count(*) AS total FROM tok JOIN vocab ON w = word GROUP BY word_id")
def a04_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = posts(spark, sf_dir)
    coded = V.encode(V.count_words(own), V.build(own))
    return coded.select("word_id", "word", F.col("cnt").alias("total"))


@query("""SELECT count(DISTINCT source) AS users, count(DISTINCT source) FILTER (length(text) > 0) AS text_users, count(*) AS posts, count(*) FILTER (length(text) > 0) AS text_posts,
  count(*) FILTER (length(text) > 0 AND quality IS NOT NULL) AS mood_posts, round(100.0 * count(*) FILTER (length(text) > 0 AND quality IS NOT NULL) / count(*) FILTER (length(text) > 0), 6) AS mood_percent
FROM documents LEFT JOIN labels USING (doc_id)""")
def a05_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return X.corpus_stats(rows, "source", F.coalesce(F.length("text") > 0, F.lit(False)), F.col("quality") + 1)


@query("SELECT least(c, 1000) AS length, count(*) AS n FROM (SELECT user_id, count(*) AS c FROM events GROUP BY user_id) GROUP BY 1")
def a06_moods_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.featurize_users(table(spark, sf_dir, "events"), mood="event_type")["moods_per_user"]


MOODS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{m}') AS \"{m}\"" for m in MOODS) + " FROM events GROUP BY user_id")
def a06_mood_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = X.moods_per_user(table(spark, sf_dir, "events"), mood="event_type")
    return X.mood_table(counts, list(MOODS), mood="event_type")


@query("WITH " + TOK + " SELECT w AS word, count(DISTINCT post_id) AS df FROM tok GROUP BY w")
def a10_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.weighting import document_frequency

    return document_frequency(X.bag_of_words(posts(spark, sf_dir), ["post_id"]))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a13_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(SENTS + """ SELECT post_id, sent, "user", 'http://' || "user" || '.example.org/' AS url FROM sents""")
def j04_sentence_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of every sentence."""
    rows = S.sentences(posts(spark, sf_dir).select("post_id", "words")).select("post_id", "sent")
    users = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("user"))
    return rows.join(users, "post_id").select("post_id", "sent", "user", T.user_url("user").alias("url"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN c_name END AS "user" FROM orders o
LEFT JOIN (SELECT *, c_custkey * 10 AS a, c_custkey * 10 + 6 AS b FROM customer) c ON o_custkey * 10 + o_orderkey % 10 BETWEEN a AND b AND c_custkey % 4 = o_custkey % 4""")
def j06_posts_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = orders.select("o_orderkey", (F.col("o_custkey") % 4).alias("file"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("start"))
    start = (F.col("c_custkey") * 10).alias("start")
    spans = customers.select((F.col("c_custkey") % 4).alias("file"), start, (F.col("c_custkey") * 10 + 6).alias("stop"), F.col("c_name").alias("user"))
    return locate_posts(own, spans).select("o_orderkey", "user")


@query("SELECT user_id, mood, coalesce(['low', 'high'][CAST(mood AS INT)], 'N/A') AS name, count(*) AS n FROM (SELECT user_id, event_id % 4 AS mood FROM events) GROUP BY ALL")
def j05_mood_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.keyword import report

    names = spark.createDataFrame([(1, "low"), (2, "high")], "mood_id long, mood string")
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4).alias("mood")).agg(F.count("*").alias("n"))
    return report(rows, names).select("user_id", "mood", F.col("mood_name").alias("name"), "n")


@query("WITH " + TOK + " SELECT origin, count(*) AS n FROM (SELECT 'post' AS origin FROM posts UNION ALL SELECT 'query' FROM benchmark) GROUP BY origin")
def u02_rows_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = posts(spark, sf_dir).select(F.lit("post").alias("origin"), "words")
    asked = table(spark, sf_dir, "benchmark").select(F.lit("query").alias("origin"), T.words("text").alias("words"))
    return own.unionByName(asked).groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS mood, count(*) AS n FROM events GROUP BY ALL")
def x01_mood_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood_windows(table(spark, sf_dir, "events"))


@query(SENTS + " SELECT md5(array_to_string(words, ' ')) AS line_md5, count(*) AS n FROM sents GROUP BY 1")
def s07_sentence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written as lines of text and read again."""
    folder = shared_folder(spark, "sentences")
    files.write_sentences(S.sentences(posts(spark, sf_dir)), folder)
    read = files.read_sentences(spark, folder)
    return read.groupBy(F.md5(F.array_join("words", " ")).alias("line_md5")).agg(F.count("*").alias("n"))


@query(VOCAB + ", e AS (SELECT word, embedding FROM vocab JOIN embeddings ON word_id = vec_id + 1) SELECT word, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM e")
def s08_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors written as lines of text and read again."""
    from .vector_queries import word_vectors

    folder = shared_folder(spark, "word-vectors")
    files.write_word_vectors(word_vectors(spark, sf_dir), folder)
    read = files.read_word_vectors(spark, folder)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return read.select("word", F.size("vector").cast("long").alias("dim"), F.round(total, 4).alias("total"))


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT word, word_id, cnt FROM vocab")
def s06_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary written in files of 5,000 rows at most and read again."""
    folder = shared_folder(spark, "vocabulary")
    files.write_table(V.build(posts(spark, sf_dir)), folder, rows_per_file=5_000)
    return spark.read.parquet(folder).select("word", "word_id", "cnt")
