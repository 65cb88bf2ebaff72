"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong parts (always reported): ``assign`` (a secret-like name with a value of 8 or more characters),
``access`` (a cloud access key id) and ``hex`` (32 or more lower-case hex digits).
Weak parts are reported only when a complementary part lies in the same scope, that is within ``reach``
characters in the same text and apart from it, so that no part vouches for itself: ``login`` (a named identifier) needs a secret near it; ``opaque`` (a long mixed
token) needs an identifier or an endpoint; ``endpoint`` (a URL or an IPv4 address) needs an identifier or a
secret. The linking is an interval semi-join: parts are dealt to cells of one scope's length, joined on text
and cell under the interval condition, and only their existence is asked for, so no pairs are made.

Positions are code points, end exclusive. Per kind, matches are leftmost and don't overlap; spans of different
kinds may. A null text counts as empty. Rows of one doc_id and one text share their spans, repeated rows keep
their own row. Rows without a match are in no shuffle. Extra columns are ignored by ``scan_secrets`` and kept by
``redact``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bind, free_names, text_or_empty


class Part(NamedTuple):
    """A pattern; a match counts when ``group`` has at least ``least`` characters (and contains each of ``also``)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    role: str = "secret"
    weak: bool = False
    also: tuple[str, ...] = ()


#: The kinds in the order in which spans of one start are listed.
PARTS = (
    Part(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Part("access", r"AKIA[A-Z0-9]+", least=16, role="identifier"),
    Part("hex", r"[0-9a-f]{32,}", least=32),
    Part(
        "login",
        r"([Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""",
        group=2,
        least=3,
        role="identifier",
        weak=True,
    ),
    Part("opaque", r"[A-Za-z0-9+/_-]{24,}={0,2}", least=24, weak=True, also=("[0-9]", "[A-Za-z]")),
    Part(
        "endpoint",
        r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?""",
        role="endpoint",
        weak=True,
    ),
)

_MATCH = "array<struct<gap:int,width:int,gap_bytes:int,bytes:int,ok:boolean>>"
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Spans of up to so many bytes in all (16 a span, 48 a text) are broadcast to the texts; beyond that, texts are shuffled.
BROADCAST_BYTES = 64 << 20


def _matches(text: Column, part: Part) -> Column:
    """All matches as (characters since the last match, width, both in bytes, whether it counts)."""
    pattern = F.lit(part.pattern)

    def measured(pair: Column) -> Column:
        return F.transform(
            pair["whole"],
            lambda m, i: F.struct(
                F.length(F.get(pair["between"], i)).alias("gap"),
                F.length(m).alias("width"),
                F.octet_length(F.get(pair["between"], i)).alias("gap_bytes"),
                F.octet_length(m).alias("bytes"),
                reduce(and_, (m.rlike(x) for x in part.also), F.length(F.get(pair["value"], i)) >= part.least).alias("ok"),
            ),
        )

    found = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(part.group)).alias("value"),
        F.split(text, part.pattern).alias("between"),
    )
    return F.when(text.rlike(part.pattern), bind(found, measured)).otherwise(F.array().cast(_MATCH))


def scan(df: DataFrame, text: str = "text", parts: tuple[Part, ...] = PARTS) -> DataFrame:
    """doc_id, text_hash and an array of matches for each kind: one pass over the texts."""
    whole = text_or_empty(text)
    return df.select("doc_id", F.xxhash64(whole).alias("text_hash"), *(_matches(whole, p).alias(p.kind) for p in parts))


def _some(parts: tuple[Part, ...]) -> Column:
    return reduce(or_, (F.size(p.kind) > 0 for p in parts))


def locate(scanned: DataFrame, parts: tuple[Part, ...] = PARTS) -> DataFrame:
    """doc_id, text_hash, rank (the kind's place in parts), kind, start, end and the same in bytes of each match that counts."""
    kinds = F.array(*(F.struct(F.lit(i).alias("rank"), F.col(p.kind).alias("found")) for i, p in enumerate(parts)))
    one = scanned.filter(_some(parts)).dropDuplicates(["doc_id", "text_hash"])
    rows = one.select("doc_id", "text_hash", F.explode(kinds).alias("k")).select(
        "doc_id", "text_hash", F.col("k.rank").alias("rank"), F.posexplode("k.found").alias("pos", "m")
    )
    upto = Window.partitionBy("doc_id", "text_hash", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end, last_byte = F.sum(F.col("m.gap") + F.col("m.width")).over(upto), F.sum(F.col("m.gap_bytes") + F.col("m.bytes")).over(upto)
    placed = rows.withColumns({"end": end.cast("int"), "last_byte": last_byte.cast("int")}).filter("m.ok")
    kind = F.get(F.array(*(F.lit(p.kind) for p in parts)), F.col("rank"))
    start, first_byte = F.col("end") - F.col("m.width"), F.col("last_byte") - F.col("m.bytes")
    return placed.select("doc_id", "text_hash", "rank", kind.alias("kind"), start.alias("start"), "end", first_byte.alias("first_byte"), "last_byte")


def link(spans: DataFrame, parts: tuple[Part, ...] = PARTS, reach: int = 200) -> DataFrame:
    """spans without the weak ones that have no complementary part within reach."""
    weak_ranks = [i for i, p in enumerate(parts) if p.weak]
    role = F.get(F.array(*(F.lit(p.role) for p in parts)), F.col("rank"))
    rows = spans.withColumn("role", role)
    strong, weak = rows.filter(~F.col("rank").isin(weak_ranks)), rows.filter(F.col("rank").isin(weak_ranks))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    left = weak.withColumn("cell", cells(F.col("start"), F.col("end")))
    right = rows.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"),
        cells(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach).alias("c"),
    )
    near = (
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("cell") == F.col("c"))
        & (F.col("role") != F.col("r")) & ((F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))) & (F.col("s") <= F.col("end") + reach) & (F.col("start") <= F.col("e") + reach)
    )
    linked = left.join(right, near, "left_semi").drop("cell").distinct()
    return strong.unionByName(linked).drop("role")


def scan_secrets(df: DataFrame, text: str = "text", parts: tuple[Part, ...] = PARTS, reach: int = 200) -> DataFrame:
    """doc_id, text_hash and ``spans``, sorted (start, rank, kind, end), for every row of df."""
    scanned = cut_lineage(scan(df, text, parts))
    spans = link(cut_lineage(locate(scanned, parts)), parts, reach)
    listed = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    listed = listed.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))
    none = F.array().cast(_SPANS)
    some = scanned.filter(_some(parts)).select("doc_id", "text_hash").join(listed, same, "left").drop("_d", "_h")
    clean = scanned.filter(~_some(parts)).select("doc_id", "text_hash", none.alias("spans"))
    return clean.unionByName(some.withColumn("spans", F.coalesce("spans", none)))


def cuts(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash and ``cuts``: the union of a text's spans as disjoint ranges of bytes, ascending. Ranges that touch are one."""
    upto = Window.partitionBy("doc_id", "text_hash").orderBy("first_byte", "last_byte")
    reached = F.max("last_byte").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.when(reached.isNull() | (F.col("first_byte") > reached), 1).otherwise(0))
    runs = opens.withColumn("run", F.sum("opens").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("first_byte").alias("first"), F.max("last_byte").alias("last"))
    return whole.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def redact(df: DataFrame, text: str = "text", parts: tuple[Part, ...] = PARTS, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """df with every reported span of ``text`` replaced by mark; overlapping spans become one mark.

    Rows without a span, and all other columns, stay as they are. A text is cut at bytes, in one pass, however many
    its spans. Texts aren't shuffled while the spans are few enough to be broadcast.
    """
    d, h, c = free_names(df, "_d", "_h", "_cuts")
    found = cut_lineage(cuts(link(cut_lineage(locate(cut_lineage(scan(df, text, parts)), parts)), parts, reach)))
    size = found.agg(F.coalesce(F.sum(48 + 16 * F.size("cuts").cast("long")), F.lit(0))).first()[0]
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("cuts").alias(c))
    whole = text_or_empty(text)

    def rebuilt(body: Column) -> Column:
        after = lambda k: F.coalesce(F.get(F.col(c), k)["last"], F.lit(0))
        piece = lambda a, n: F.substring(body, a + 1, n).cast("string")
        before = F.transform(F.col(c), lambda r, j: piece(after(j - 1), r["first"] - after(j - 1)))
        end = after(F.size(c) - 1)
        return F.array_join(F.concat(before, F.array(piece(end, F.length(body) - end))), mark)

    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(whole) == F.col(h))
    clean = F.when(F.col(c).isNull(), F.col(text)).otherwise(bind(whole.cast("binary"), rebuilt))
    return df.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, same, "left").withColumn(text, clean).drop(d, h, c)
