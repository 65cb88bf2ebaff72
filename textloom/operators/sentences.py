"""Posts into sentences, inside each row: arrays are cut where a sentence ends, so nothing is shuffled.

Modes
    post    a terminator (. ! ?) stays at the end of its sentence and an ellipsis ends none. A terminator at the
            very start of a post opens its first sentence (and leaves an empty sentence 0 before it).
    stream  terminators (. ! ? ...) are dropped, runs of them count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import let

MODES = ("post", "stream")


def _cut(tokens: Column, ends: Column) -> Column:
    """Slices of tokens that end at the 0-based positions given in order."""
    return let(
        ends,
        lambda e: F.transform(
            F.arrays_zip(e.alias("stop"), F.slice(F.concat(F.array(F.lit(-1)), e), F.lit(1), F.size(e)).alias("before")),
            lambda x: F.slice(tokens, x["before"] + 2, x["stop"] - x["before"]),
        ),
    )


def split_words(tokens: Column, mode: str = "post") -> Column:
    """array<array<string>>: the sentences of one post's words."""
    last = F.size(tokens) - 1
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    none = F.array().cast("array<array<string>>")
    if mode == "post":
        ends = F.filter(places, lambda i: ((i > 0) & F.get(tokens, i).isin(*T.TERMINATORS)) | (i == last))
        return F.when(last >= 0, _cut(tokens, ends)).otherwise(none)
    if mode == "stream":
        stops = (*T.TERMINATORS, "...")
        ends = F.filter(places, lambda i: F.get(tokens, i).isin(*stops) | (i == last))
        bare = F.transform(F.when(last >= 0, _cut(tokens, ends)).otherwise(none), lambda s: F.filter(s, lambda x: ~x.isin(*stops)))
        return F.filter(bare, lambda s: F.size(s) > 0)
    raise ValueError(f"mode is one of {MODES}, not {mode!r}")


def sentences(posts: DataFrame, mode: str = "post", words: str = "words", keep_empty: bool = False, most: int | None = None) -> DataFrame:
    """One row a sentence: posts' other columns, sent (number in its post), words, n_words.

    sent counts from 0; in post mode a post that begins with a terminator begins at 1, and keep_empty gives its
    empty sentence 0 too. most cuts the words shown (n_words counts all). Null words: no sentence.
    """
    w = F.coalesce(F.col(words), F.array().cast("array<string>"))
    others = [posts[c] for c in posts.columns if c not in (words, "sent", "n_words")]
    led = (F.size(w) > 0) & F.get(w, F.lit(0)).isin(*T.TERMINATORS) if mode == "post" else F.lit(False)
    parts = split_words(w, mode)
    if keep_empty:
        parts = F.when(led, F.concat(F.array(F.array().cast("array<string>")), parts)).otherwise(parts)
        led = F.lit(False)
    # How a post begins is told before it is cut: told beside the explode, each of its sentences would carry all of its words.
    told = posts.select(*others, posts[words], led.alias("_led"))
    # An outer explode, as a test below an inner one would cut the post again.
    kept = [c for c in told.columns if c != words]
    rows = told.select(*kept, F.posexplode_outer(parts).alias("sent", words)).filter(F.col("sent").isNotNull())
    shown = F.col(words) if most is None else F.slice(words, 1, most)
    return rows.select(
        *(c for c in posts.columns if c not in (words, "sent", "n_words")),
        (F.col("sent") + F.col("_led").cast("int")).cast("long").alias("sent"),
        shown.alias(words),
        F.size(words).cast("long").alias("n_words"),
    )


def length_histogram(rows: DataFrame, length: str | Column = "n_words", cap: int = 500) -> DataFrame:
    """(length, n): how many rows have each length; lengths over cap count as cap."""
    value = F.col(length) if isinstance(length, str) else length
    return rows.groupBy(F.least(value, F.lit(cap)).cast("long").alias("length")).agg(F.count("*").alias("n"))
