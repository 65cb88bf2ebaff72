"""Bag-of-words features, mood counts and corpus statistics as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import exploded, let

# The domain of mood ids.
MOOD_LAST = 134
MOODS_INVALID = (50, 94)


def valid_mood(mood: Column) -> Column:
    """Ids 1 to 134 without the two that were never assigned; false for null."""
    return F.coalesce(mood.between(1, MOOD_LAST) & ~mood.isin(*MOODS_INVALID), F.lit(False))


def single_mood(moods: Column) -> Column:
    """The mood of a post that has exactly one, else null. moods is an array of ids (null: custom moods)."""
    return F.when(F.size(moods) == 1, moods[0])


def bag(words: str | Column) -> Column:
    """array<struct<word, cnt>> of a row's words, ordered by word: equal words stand together once sorted."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return let(
            starts,
            lambda s: F.transform(
                s, lambda i, k: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).cast("long").alias("cnt"))
            ),
        )

    column = F.col(words) if isinstance(words, str) else words
    none = F.array().cast("array<struct<word:string,cnt:bigint>>")
    return F.when(F.size(column) > 0, let(F.array_sort(column), runs)).otherwise(none)


def bag_of_words(rows: DataFrame, keys: list[str], words: str = "words", one_row: bool = False) -> DataFrame:
    """(keys, word, cnt): repeated words added up, combined before the shuffle.

    one_row: each key has one row, so its words are added up inside it and nothing is shuffled.
    """
    if one_row:
        return exploded(rows, keys, bag(words), "_b").select(*keys, "_b.*")
    return exploded(rows, keys, F.col(words)).groupBy(*keys, "word").agg(F.count("*").alias("cnt"))


def moods_per_user(events: DataFrame, user: str = "user_id", mood: str = "mood") -> DataFrame:
    return events.filter(F.col(mood).isNotNull()).groupBy(user, mood).agg(F.count("*").alias("cnt"))


def mood_table(counts: DataFrame, moods: list, user: str = "user_id", mood: str = "mood") -> DataFrame:
    """One row a user, one column a mood; moods are given, so the pivot needs no extra pass."""
    wide = counts.groupBy(user).pivot(mood, moods).agg(F.sum("cnt"))
    return wide.na.fill(0)


def corpus_stats(posts: DataFrame, user: str, has_text: Column, mood: Column) -> DataFrame:
    """One row: users, users with a text, posts, text posts, text posts with a valid mood and their percentage."""
    text_posts = F.count_if(has_text)
    valid = F.count_if(has_text & valid_mood(mood))
    return posts.agg(
        F.countDistinct(user).alias("users"),
        F.countDistinct(F.when(has_text, F.col(user))).alias("text_users"),
        F.count("*").alias("posts"),
        text_posts.alias("text_posts"),
        valid.alias("mood_posts"),
        F.round(F.lit(100.0) * valid / F.nullif(text_posts, F.lit(0)), 6).alias("mood_percent"),
    )


def histogram_stats(histogram: DataFrame, key: str = "length", n: str = "n") -> DataFrame:
    """Mean, median (first key whose running count passes half) and mode (smallest of the most frequent).

    A histogram has at most as many rows as its cap, so its running sum may be made in one task.
    """
    running = F.sum(n).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = histogram.select(F.col(key).alias("k"), F.col(n).alias("n"), running.alias("upto"), total.alias("total"))
    return rows.agg(
        F.sum("n").cast("long").alias("rows"),
        F.round(F.sum(F.col("k") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        F.min(F.when(2 * F.col("upto") > F.col("total"), F.col("k"))).alias("median"),
        F.max_by("k", F.struct("n", -F.col("k"))).alias("mode"),
    )


def featurize_posts(posts: DataFrame, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Posts (post_id, user, mood, words) to words per post, labels and histograms.

    Only posts with a valid mood count. The mood histogram also counts posts that are left without a known word.
    """
    from . import sentences, vocabulary as V

    valid = posts.filter(valid_mood(F.col("mood")))
    known = V.known_words(valid, vocabulary) if vocabulary is not None else valid.filter(F.size("words") > 0)
    return {
        # Posts without words give no rows; a test of their words here would make them twice.
        "bow": bag_of_words(valid if vocabulary is None else known, ["post_id"]),
        "labels": known.select("post_id", "user", "mood"),
        "moods": valid.groupBy("mood").agg(F.count("*").alias("n")),
        "lengths_before": sentences.length_histogram(valid, F.size("words"), 100_000),
        "lengths_after": sentences.length_histogram(known, F.size("words"), 100_000),
    }


def featurize_sentences(posts: DataFrame, vocabulary: DataFrame | None = None, mode: str = "post", most: int = 500) -> DataFrame:
    """Sentences of posts (post_id, user, mood, words), split after unknown words have gone in post mode.

    Stream mode keeps unknown words and asks for no mood.
    """
    from . import sentences, vocabulary as V

    if mode == "post":
        posts = posts.filter(valid_mood(F.col("mood")))
        if vocabulary is not None:
            posts = V.known_words(posts, vocabulary)
    return sentences.sentences(posts, mode, most=most)


def featurize_users(events: DataFrame, user: str = "user_id", mood: str = "mood", cap: int = 1000) -> dict[str, DataFrame]:
    """Mood counts per user, and how many users have how many moods."""
    from . import sentences

    counts = moods_per_user(events, user, mood)
    per_user = counts.groupBy(user).agg(F.sum("cnt").alias("n_moods"))
    return {"counts": counts, "moods_per_user": sentences.length_histogram(per_user, "n_moods", cap)}
