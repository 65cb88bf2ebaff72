"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each rule names a metric, a lower and an upper bound; ``None`` leaves a side open. A null text counts as
empty: no words, no lines, every ratio 0. Rules on ratios apply only to texts with at least one word.
Repeated rows are judged one by one; extra columns pass through (a column of an output's name is replaced).
Cost per text of n words is O(n log n); nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, bind, text_or_empty

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "al como con del el es esta las los no para por se su una y "
    "als auf das dem den der die ein eine für im ist mit nicht sich und von zu"
).split()


class Rule(NamedTuple):
    """Keep a text while low <= metric <= high."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars_per_word", 1.5, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_words_per_word", 0.01, None),
    Rule("duplicate_lines", "dup_lines_per_line", None, 0.3),
    Rule("ellipsis_lines", "ellipsis_lines_per_line", None, 0.5),
)


def _repeat_words(words: Column, width: int) -> Column:
    """Words that lie in a window of ``width`` words found at least twice in the text.

    Windows are compared by 64-bit hash. Sorting (hash, position) puts equal windows side by side, so no
    pair of windows is enumerated.
    """

    def covered(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return bind(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1) - x, F.lit(width)))),
                F.lit(0),
                lambda total, gap: total + gap,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))),
    )
    any_twice = lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered),
    ).otherwise(0)
    return F.when(F.size(words) > width, bind(windows, any_twice)).otherwise(0)


def metrics(df: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """df with the counts and ratios that the rules use."""
    split = df.withColumns(
        {
            "_words": F.array_remove(F.split(text_or_empty(text), SPACES), ""),
            "_lines": F.filter(F.split(text_or_empty(text), "\n"), lambda line: line.rlike(WORD)),
        }
    )
    counted = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text_or_empty(text), F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words"), window).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("..."))).cast("long"),
        }
    ).drop("_words", "_lines")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.withColumns(
        {
            "word_chars_per_word": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "stop_words_per_word": per("n_stop_words", "n_words"),
            "dup_lines_per_line": per("n_dup_lines", "n_lines"),
            "ellipsis_lines_per_line": per("n_ellipsis_lines", "n_lines"),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One array column: the names of the rules that a row of ``metrics`` breaks."""
    broken = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (F.col(rule.metric) < rule.low)
        if rule.high is not None:
            bad = bad | (F.col(rule.metric) > rule.high)
        broken.append(F.when(bad & (F.col("n_words") > 0), F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(
    df: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """df with its metrics, ``base_failed``, ``broken_rules`` and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = metrics(df, text).withColumns({"base_failed": failed, "broken_rules": compile_rules(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
