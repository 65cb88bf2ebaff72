"""Fielded keyword search over posts: terms, phrases, prefixes, musts and exclusions, ranked by tf-idf.

A query is a list of parts: words in a field, each of which must, may or must not occur. A query that has a must
matches the posts with all its musts; otherwise one of its parts is enough. Queries without a must or a may match nothing.

Score: for each term and prefix the sum of sqrt(tf) * (1 + ln(N / (df + 1)))^2 / sqrt(field length), phrases as if
they were one term; equal scores go by key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.columns import exploded

# Words that the analyser drops.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
FIELDS = ("ptext", "user", "path", "url", "mood")


@dataclass(frozen=True)
class Part:
    """One part of a query: its words in a field, as a term (or phrase, if there are several) or as a prefix."""

    words: tuple[str, ...]
    field: str = "ptext"
    need: str = "may"
    prefix: bool = False


def part(text: str, need: str = "may", field: str = "ptext", prefix: bool = False) -> Part | None:
    """A part as the analyser reads its text; None if no word is left. need is must, may or not."""
    if field not in FIELDS or need not in ("must", "may", "not"):
        raise ValueError(f"unknown field {field!r} or need {need!r}; the fields are {FIELDS}")
    words = tuple(w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS)
    return Part(words, field, need, prefix) if words else None


def analyse(text: str | Column) -> Column:
    """Lower-case letter and digit runs without stop words."""
    column = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(F.coalesce(column.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*STOP_WORDS))


def _count(part: Part) -> Column:
    """How often a part occurs in its field."""
    tokens = F.col(f"tokens_{part.field}")
    if part.prefix:
        return F.size(F.filter(tokens, lambda x: x.startswith(part.words[0])))
    if len(part.words) == 1:
        return F.size(F.filter(tokens, lambda x: x == part.words[0]))
    n = len(part.words)
    places = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    wanted = F.array(*(F.lit(w) for w in part.words))
    return F.size(F.filter(places, lambda i: F.slice(tokens, i, F.lit(n)) == wanted))


def analysed(posts: DataFrame, key: str = "post_id") -> DataFrame:
    """posts with tokens_<field> for each field there is; write it once to search it often."""
    return posts.select("*", *(analyse(f).alias(f"tokens_{f}") for f in FIELDS if f in posts.columns))


Query = Sequence[Part | None]


def search(posts: DataFrame, query: Query, k: int = 10, key: str = "post_id") -> DataFrame:
    """The k best posts with score and rank. posts are analysed; the df of the parts is counted in one pass over them."""
    return search_batch(posts, [query], k, key).drop("query_id")


def search_batch(posts: DataFrame, queries: Sequence[Query], k: int = 10, key: str = "post_id") -> DataFrame:
    """search for each query, all in one pass: (query_id, …, score, rank)."""
    return _ranked(posts, {i: [p for p in q if p is not None] for i, q in enumerate(queries)}, k, key)


def _ranked(posts: DataFrame, queries: dict[int, list[Part]], k: int, key: str) -> DataFrame:
    from pyspark.sql import Window

    shown = [c for c in posts.columns if not c.startswith("tokens_")]
    asked = [p for q in queries.values() for p in q]
    if all(p.need == "not" for p in asked):
        return posts.select(*shown, F.lit(0).cast("long").alias("query_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    # A part is counted once, whatever the queries need of it.
    number = {p: i for i, p in enumerate(dict.fromkeys(replace(p, need="may") for p in asked))}
    of = lambda p: number[replace(p, need="may")]
    lengths = [F.size(f"tokens_{f}").alias(f"n_{f}") for f in {p.field for p in number}]
    counted = posts.select(*shown, *lengths, *(_count(p).alias(f"tf{i}") for p, i in number.items()))
    df = counted.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in number.values()))
    rows = counted.crossJoin(F.broadcast(df))  # one row of counts

    def judged(qid: int, own: list[Part]) -> Column:
        has = lambda p: F.col(f"tf{of(p)}") > 0
        must, may, no = ([p for p in own if p.need == x] for x in ("must", "may", "not"))
        test = F.lit(bool(must or may))
        for p in must:
            test = test & has(p)
        if may and not must:
            any_of = F.lit(False)
            for p in may:
                any_of = any_of | has(p)
            test = test & any_of
        for p in no:
            test = test & ~has(p)
        total = F.lit(0.0)
        for p in (*must, *may):
            idf = 1 + F.log(F.col("n") / (F.col(f"df{of(p)}") + 1))
            total = total + F.sqrt(F.col(f"tf{of(p)}").cast("double")) * idf * idf / F.sqrt(F.greatest(F.col(f"n_{p.field}"), F.lit(1)).cast("double"))
        return F.when(test, F.struct(F.lit(qid).cast("long").alias("query_id"), F.round(total, 6).alias("score")))

    hits = F.filter(F.array(*(judged(i, q) for i, q in queries.items())), lambda x: x.isNotNull())
    flat = exploded(rows, shown, hits, "_hit").select(*shown, "_hit.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return flat.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def postings(posts: DataFrame, key: str = "post_id", field: str = "ptext") -> DataFrame:
    """(term, key, tf): an inverted table to write by term and look up."""
    flat = exploded(posts, [key], analyse(field), "term")
    return flat.groupBy("term", key).agg(F.count("*").cast("long").alias("tf"))


def report(hits: DataFrame, moods: DataFrame) -> DataFrame:
    """Hits with the name of their mood; N/A for moods that have none."""
    names = moods.select(F.col("mood_id").alias("mood"), F.col("mood").alias("mood_name"))
    return hits.join(F.broadcast(names), "mood", "left").withColumn("mood_name", F.coalesce("mood_name", F.lit("N/A")))


def interactive(spark: SparkSession, posts: DataFrame, ask, show, k: int = 10) -> None:
    """Ask for queries and show their hits until there is none."""
    while (query := ask()) is not None:
        show(search(posts, query, k))
