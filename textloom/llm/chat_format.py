"""Chat formatting with Spark expressions only.

Turn rows are collected per conversation, sorted (turn, role, text; null first), adjacent turns of one role
are merged by aggregating their texts into one array, and the pieces are concatenated as

    <s>role NEWLINE text <sep> text ... </s>

``<sep>`` stands between the texts that a merge joined, so reading back restores every turn. Control strings
inside texts and roles get one backslash after their first character (strings that already carry backslashes
there get one more), which ``unescape`` takes away again.

A null text is an empty one, a null role an empty role; rows of a null conversation id form one conversation.
Repeated rows stay as turns of their own. Extra columns are ignored. A conversation becomes one output string,
so it is gathered by one task: its length bounds that task, as it does for any reader of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, text_or_empty

OPEN, SEP, CLOSE = "<s>", "<sep>", "</s>"

#: Control strings that a text may not contain unescaped; each is its first character and a rest.
_FIRST, _REST = r"([<\[])", r"(/?s>|sep>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    lines = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00")), F.lit("\\n"), F.lit("\n"))
    return F.replace(lines, F.lit("\\\x00"), F.lit("\\"))


def collect_turns(df: DataFrame) -> DataFrame:
    """conv_id and ``turns``: its sorted array of (turn, role, text)."""
    turn = F.struct("turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merge_turns(turns: Column) -> Column:
    """Array of (role, texts): runs of one role, each aggregated into one array of its texts."""

    def runs(ts: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ts) - 1),
            lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]),
        )

        def fold(begin: Column, following: Column) -> Column:
            own = F.slice(ts, begin + 1, F.coalesce(following, F.size(ts)) - begin)
            return F.struct(
                F.get(ts, begin)["role"].alias("role"),
                F.transform(own, lambda t: t["text"]).alias("texts"),
            )

        return bind(starts, lambda s: F.transform(s, lambda begin, k: fold(begin, F.get(s, k + 1))))

    return bind(turns, runs)


def format_chats(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, ``formatted`` and ``loss_spans``: [begin, end) in code points of each text that is trained on."""

    def pieces(turn: Column) -> Column:
        last = F.size(turn["texts"]) - 1
        return F.transform(
            turn["texts"],
            lambda text, i: F.struct(
                F.when(i == 0, F.concat(F.lit(OPEN), _escape_role(turn["role"]), F.lit("\n"))).otherwise(SEP).alias("before"),
                escape(text).alias("body"),
                F.when(i == last, CLOSE).otherwise("").alias("after"),
                turn["role"].isin(*loss_roles).alias("loss"),
            ),
        )

    merged = collect_turns(df).withColumn("merged", merge_turns(F.col("turns")))
    rows = merged.select("conv_id", F.posexplode(F.flatten(F.transform("merged", pieces))).alias("pos", "p"))
    width = F.length("p.before") + F.length("p.body") + F.length("p.after")
    earlier = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(width).over(earlier), F.lit(0)) + F.length("p.before")
    placed = rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("p.body"))
    text = F.concat("p.before", "p.body", "p.after")
    parts = F.sort_array(F.collect_list(F.struct("pos", text.alias("text"))))
    spans = F.sort_array(F.collect_list(F.when(F.col("p.loss"), F.struct("begin", "end"))))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), one for each turn that was formatted."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block))
        name = _unescape_role(F.substring(role, F.lit(len(OPEN) + 1), F.length(role)))
        return F.transform(F.split(body, SEP), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    inside = lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))
    return F.array_join(F.transform(spans, inside), "")
