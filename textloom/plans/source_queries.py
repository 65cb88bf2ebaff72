"""Queries that write rows in a file format and read them again by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import features as X
from textloom.operators import moods as M
from textloom.operators import semantic as Q
from textloom.operators import vocabulary as V
from textloom.session import shared_folder
from textloom.sources import files
from textloom.sources import posts as P
from textloom.sources.files import table
from textloom.sources.mini_batches import mini_batches
from textloom.sources.sparse_matrix import read_matrix, write_matrix
from textloom.streaming import ingest

from . import vector_queries as VQ
from .registry import BASE64_SQL, MARKUP_SQL, ORACLES, TOK, TOKEN_SQL, canonical_sql, labelled, posts, query, vocabulary_sql


def _words_sql(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({text}, '{TOKEN_SQL}'), lambda x: NOT regexp_matches(x, '^-?[0-9]')), lambda x: {canonical_sql('x')})"


_CLEAN = f"regexp_replace(regexp_replace(text, '{BASE64_SQL}', '', 'g'), '{MARKUP_SQL}', '', 'g')"


@query(f"""SELECT doc_id AS item_id, source AS "user", CASE WHEN doc_id % 3 = 1 THEN doc_id % 134 END AS mood_id, md5(array_to_string({_words_sql(_CLEAN)}, ' ')) AS words_md5
FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0""")
def p01_xml_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as XML blocks, each with a second post that has no text: posts with a text event stay, moods only where
    there is one."""
    mood = F.struct((F.col("doc_id") % 134).cast("int").alias("int"))
    post = F.struct(
        F.col("source").alias("user"), F.struct(F.col("doc_id").alias("int")).alias("itemid"), F.struct(F.col("text").alias("string")).alias("event"),
        F.slice(F.array(mood, mood), F.lit(1), (F.col("doc_id") % 3).cast("int")).alias("current_moodid"),
    )
    bare = post.withField("event", F.struct(F.lit(None).cast("string").alias("string")))
    folder = shared_folder(spark, "posts-xml")
    table(spark, sf_dir, "documents").select(F.array(post, bare).alias("post")).write.option("rowTag", "posts").option("rootTag", "export").format("xml").save(folder)
    read = P.read_posts(spark, folder).filter("text IS NOT NULL")
    words = F.md5(F.array_join(T.words("text"), " ")).alias("words_md5")
    return read.select(F.col("item_id").cast("long").alias("item_id"), "user", F.col("mood_id").cast("long").alias("mood_id"), words)


@query(f"""WITH t AS (SELECT unnest({_words_sql(_CLEAN)}) AS w FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0
), c AS (SELECT w AS word, count(*) AS cnt FROM t GROUP BY w)
SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS word_id FROM c""")
def s03_tokenised_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts arrive as XML files in two lots; each run tokenises the new files only, and the dictionary counts all."""
    folder, target = shared_folder(spark, "arriving"), shared_folder(spark, "tokenised")
    post = F.struct(F.col("source").alias("user"), F.struct(F.col("text").alias("string")).alias("event"))
    for k in range(2):
        lot = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == k).select(F.array(post).alias("post"))
        lot.write.mode("append").option("rowTag", "posts").option("rootTag", "export").option("extension", "xml").format("xml").save(folder)
        ingest.tokenise_new(spark, folder, target)
    return ingest.dictionary(spark, target, most=None).select("word", "cnt", "word_id")


@query("SELECT k // 1000 AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1")
def s11_mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files of at most 700 rows, dealt into batches of 1,000: the rows that each batch has."""
    folder = shared_folder(spark, "orders")
    files.write_table(table(spark, sf_dir, "orders").select("o_orderkey"), folder, rows_per_file=700)
    return mini_batches(spark, folder, 1000).groupBy("batch").agg(F.count("*").alias("n"))


@query(f"""SELECT source AS "user", md5(array_to_string({_words_sql(_CLEAN)}, ' ')) AS words_md5, count(*) AS n
FROM documents WHERE source IS NOT NULL AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 GROUP BY ALL""")
def s02_strict_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of one user and one text each, written as XML and read by the strict reader."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull() & (F.length(F.regexp_replace("text", r"^[ \t\n\r]+", "")) > 0))
    folder = shared_folder(spark, "strict-xml")
    docs.select(F.col("source").alias("user"), F.struct(F.col("text").alias("string")).alias("event")).write.option("rowTag", "post").option("rootTag", "posts").format("xml").save(folder)
    read = P.read_posts_strict(spark, folder)
    return read.groupBy("user", F.md5(F.array_join(T.words("text"), " ")).alias("words_md5")).agg(F.count("*").alias("n"))


def _mood_file(spark: SparkSession, sf_dir: str, header: bool) -> str:
    """Parts as moods of three levels under their brands, as a taxonomy file; some of the missing ids are among them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", ",", " ").alias("name"), "p_brand")
    cells = [(F.col("p_partkey") + 51).cast("string"), F.col("name")]
    cells += [(F.col("p_partkey") % 3 + 1).cast("string"), (F.col("p_partkey") % 7).cast("string"), F.col("p_brand")] if header else []
    lines = parts.select(F.concat_ws(",", *cells).alias("value"))
    if header:
        lines = lines.unionByName(spark.createDataFrame([("id,mood,level,parent id,parent",)], "value string"))
    folder = shared_folder(spark, "moods")
    lines.write.option("lineSep", "\r").text(folder)
    return folder


_PARTS = "p AS (SELECT p_partkey + 51 AS mood_id, replace(p_name, ',', ' ') AS mood, p_partkey % 3 + 1 AS level, p_partkey % 7 AS parent_id, p_brand AS parent FROM part)"
_DICTIONARY = f"WITH {_PARTS}, m AS (SELECT * FROM p UNION ALL SELECT id, name, NULL, NULL, NULL FROM (VALUES (0, 'empty'), (50, 'invalid'), (94, 'invalid2')) AS v(id, name) WHERE id NOT IN (SELECT mood_id FROM p))"


@query(_DICTIONARY + " SELECT CAST(mood_id AS BIGINT) AS mood_id, mood, CAST(level AS BIGINT) AS level, CAST(parent_id AS BIGINT) AS parent_id, parent FROM m")
def s04_mood_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    moods = files.read_moods(spark, _mood_file(spark, sf_dir, header=True))
    return moods.select(*(F.col(c).cast("long").alias(c) for c in ("mood_id", "level", "parent_id")), "mood", "parent")


@query(f"WITH {_PARTS} SELECT CAST(mood_id AS BIGINT) AS mood_id, mood FROM p UNION ALL SELECT -1, 'N/A'")
def s04b_search_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    moods = files.read_moods(spark, _mood_file(spark, sf_dir, header=False), header=False)
    return moods.select(F.col("mood_id").cast("long").alias("mood_id"), "mood")


@query(_DICTIONARY + " SELECT level::BIGINT AS level, count(*) AS n FROM m GROUP BY level")
def d01_mood_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mood dictionary, missing ids added, by level."""
    levels = M.levels(files.read_moods(spark, _mood_file(spark, sf_dir, header=True)))
    return levels.select(F.col("level").cast("long").alias("level"), "n")


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT CAST(count(*) AS BIGINT) AS n_words, md5(string_agg(word, ' ' ORDER BY word_id)) AS line_md5 FROM vocab")
def s08b_words_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary (a million words at most) as one line."""
    line = files.words_line(V.build(posts(spark, sf_dir)))
    return line.select(F.size(F.split("value", " ")).cast("long").alias("n_words"), F.md5("value").alias("line_md5"))


@query("WITH " + TOK + ", " + vocabulary_sql() + " SELECT word FROM vocab")
def s08c_words_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as a word a line."""
    folder = shared_folder(spark, "words")
    files.write_words(V.build(posts(spark, sf_dir)), folder)
    return spark.read.text(folder).select(F.col("value").alias("word"))


@query("""SELECT row_number() OVER (ORDER BY "user") AS user_id, "user" FROM (SELECT DISTINCT regexp_replace(regexp_extract(url, '[^/]*$'), '\\.xml$', '') AS "user" FROM pages WHERE url IS NOT NULL)""")
def s09_user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the end of paths, numbered by name."""
    return P.number_names(table(spark, sf_dir, "pages").filter("url IS NOT NULL").select(F.col("url").alias("path")))


@query(ORACLES["m05_roc_curve"])
def s10_saved_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a curve written as CSV and read again."""
    folder = shared_folder(spark, "metrics")
    files.write_metrics(VQ.m05_roc_curve(spark, sf_dir), folder, "csv")
    return spark.read.schema("k long, tpr double, fpr double").option("header", True).csv(folder)


_LABELLED_WORDS = "WITH " + TOK + ", " + vocabulary_sql() + ", e AS (SELECT post_id, word_id, count(*) AS cnt FROM tok JOIN labels ON doc_id = post_id JOIN vocab ON w = word GROUP BY ALL)"


def _word_matrix(spark: SparkSession, sf_dir: str) -> str:
    """The words of labelled posts, a column a post, as a sparse matrix in the shared folder."""
    rows = X.featurize_posts(labelled(spark, sf_dir))["bow"]
    folder = shared_folder(spark, "matrix")
    write_matrix(V.encode(rows, V.build(posts(spark, sf_dir))), folder, "word_id", "post_id", "cnt")
    return folder


@query(_LABELLED_WORDS + " SELECT post_id, word_id, cnt FROM e")
def s10_sparse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of words written as a sparse matrix and read again."""
    read = read_matrix(spark, _word_matrix(spark, sf_dir))
    return read.select(F.col("col").alias("post_id"), F.col("row").alias("word_id"), F.col("value").cast("long").alias("cnt"))


@query(_LABELLED_WORDS + " SELECT word_id, count(*) AS n_posts, sum(cnt)::BIGINT AS n FROM e GROUP BY word_id")
def s05_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's posts and uses, from two loads of the matrix: the columns up to 500, and those from 501 on."""
    folder = _word_matrix(spark, sf_dir)
    both = read_matrix(spark, folder, last=500).unionByName(read_matrix(spark, folder, first=501))
    return both.groupBy(F.col("row").alias("word_id")).agg(F.count("*").alias("n_posts"), F.sum("value").cast("long").alias("n"))


@query(ORACLES["q05_batch"])
def q12_saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a batch in a folder a query, read again."""
    folder = shared_folder(spark, "results")
    Q.save_results(VQ.q05_batch(spark, sf_dir), folder)
    return spark.read.parquet(folder).withColumn("query_id", F.col("query_id").cast("long"))
