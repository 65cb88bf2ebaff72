"""Queries by name, each with DuckDB SQL where SQL says the same, and SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.files import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function by its name, with its SQL if there is one."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: post_id, user, lang, words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select(F.col("doc_id").alias("post_id"), F.col("source").alias("user"), "lang", T.words("text").alias("words"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts with mood 1 (low quality) or 2 (high quality)."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), (F.col("quality") + 1).alias("mood"))
    return posts(spark, sf_dir).join(labels, "post_id")


#: The lexical rules, said again for the SQL, so that a change of the library's shows.
EMOTICON_SQL = r"""<[\\/]?3+|[)(\]\[]-[:;8=]|[(\[][:;8=]|:''-?\(|[:;]o\)|:-\|{1,2}|:\^\)|>?:-?<|>?[:;]-[(\[{O]|>?[:;=][(\[{O]|[:;=]-?[>)}PD/o\]\\]|[8:]-?D|:@|:\||D:<?|D[8=]|8\)|\^[-_]\^"""
TOKEN_SQL = rf"""\.\.+|https?://|{EMOTICON_SQL}|-?[0-9]+\.[0-9]*|-?[0-9]+|[a-zA-Z_]+|[;:,.?!]"""
BASE64_SQL = r"<base64>[^<>]+</base64>"
MARKUP_SQL = r"<[^&<=>]{1,15}>|<[^&<=>]*=[^&<>]*>|<![^&<>]*>|</?[wo]:[^&<>]*>|</?st[0-9]:[^&<>]*>|<option +selected>|&(?:nbsp|quot|amp);|&#xD;|\r"


def canonical_sql(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^\.\.+$') THEN '...' WHEN regexp_matches({x}, '^<3+$') THEN '<3' WHEN regexp_matches({x}, '^<[\\/]3+$') THEN '</3' ELSE lower({x}) END"


POSTS = f"""raw AS (
  SELECT doc_id AS post_id, source AS "user", lang, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS r FROM documents
), posts AS (
  SELECT post_id, "user", lang, list_transform(list_filter(r, lambda x: NOT regexp_matches(x, '^-?[0-9]')), lambda x: {canonical_sql("x")}) AS words FROM raw
)"""
TOK = POSTS + """, tok AS (
  SELECT post_id, "user", lang, unnest(words) AS w, unnest(range(len(words))) AS pos FROM posts
)"""


def sentences_sql(tok: str = "tok") -> str:
    """sid: tokens with their sentence in post mode; sents: a row a sentence."""
    return f"""sid AS (
  SELECT *, CASE WHEN pos = 0 THEN (w IN ('.', '!', '?'))::INT ELSE sum((w IN ('.', '!', '?'))::INT) OVER (
    PARTITION BY post_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END::BIGINT AS sent FROM {tok}
), sents AS (
  SELECT post_id, sent, any_value("user") AS "user", list(w ORDER BY pos) AS words, count(*) AS n_words FROM sid GROUP BY post_id, sent
)"""


def vocabulary_sql(most: int = 1_000_000, tok: str = "tok") -> str:
    return f"""cnts AS (
  SELECT w AS word, count(*) AS cnt FROM {tok} GROUP BY w
), hist AS (
  SELECT cnt, sum(count(*)) OVER (ORDER BY cnt DESC) AS above FROM cnts GROUP BY cnt
), vocab AS (
  SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS word_id FROM cnts WHERE cnt IN (SELECT cnt FROM hist WHERE above <= {most})
)"""


SENTS = "WITH " + TOK + ", " + sentences_sql()
VOCAB = "WITH " + TOK + ", " + vocabulary_sql()
#: Words are bound to vectors by word_id = vec_id + 1.
VECTORS = VOCAB + ", wv AS (SELECT word, embedding FROM vocab JOIN embeddings ON word_id = vec_id + 1)"
SENTENCE_VECTORS = (
    VECTORS
    + ", "
    + sentences_sql()
    + """, sv AS (
  SELECT post_id, sent, d, sum(v) AS v FROM (
    SELECT post_id, sent, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM sid JOIN wv ON w = word
  ) GROUP BY post_id, sent, d
), sn AS (
  SELECT post_id, sent, sqrt(sum(v * v)) AS n FROM sv GROUP BY post_id, sent
)"""
)
