"""URL filters by a Bloom filter cascade: exact membership in a list of keys, without a join.

Keys. A list's entry is a host and a path; it fits its host and all subdomains if the url's path starts with the
entry's (an empty path fits any). Its key is host || path. How many labels and path characters an entry has is its
shape, and a url has one candidate key a shape: the host's last labels and the path's first characters. All distinct
candidates of the corpus are the key universe.

Cascade. Level 1 is a Bloom filter of the listed keys of the universe. The other keys of the universe that it takes in
by mistake are encoded by level 2, the listed keys that level 2 takes in by level 3, and so on, until a level makes no
mistake. A key belongs to the list if the first level that turns it away is even (or there is none and the last is
odd). So every key of the universe is answered rightly; nothing is promised for other keys. Level 1 has the rate
sqrt(1/2) * listed / others, the others 1/2 and one hash, which makes about 1.44 * log2(others / listed) + 5 bits
a listed key; from the third on, a level of at most ``FEW`` keys gets the bits to make no mistake, most likely, which
ends the cascade. Positions are XXH64 of key, level and number, so levels err independently.

All levels are words of one array of longs that a scalar subquery gives to the projection; its size is known from the
counts before it is made. Beyond ``MAX_BITS`` a list is joined instead, shape by shape, and adaptive execution splits
hot keys: both give the same rows.

Verdicts. Of the rules that fit, the one with the longest key wins (equal length: more labels); whether it blocks is
told by a second cascade over the rules' keys. A url without a rule is blocked if the block list fits, else allowed.

A null url, or one without ``://``, has an empty host and path, which nothing fits. Entries without a host are
ignored, a null path is empty, an entry whose path doesn't begin with ``/`` fits nothing. A key with both actions
blocks; other actions than block allow. Repeated rows are judged one by one; extra columns pass through, those named
like an output are replaced. Empty lists fit nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_names

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BITS = 1 << 28  # 32 MB
MAX_LEVELS = 64
FEW = 1024
CHUNK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


Shape = tuple[int, int]


class Level(NamedTuple):
    offset: int  # of its first word in the array
    bits: int
    hashes: int


class Cascade(NamedTuple):
    """words: one row with an array of longs; levels: where each level lies in it."""

    words: DataFrame
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        if not self.levels:
            return F.lit(False)
        found = F.lit(len(self.levels) % 2 == 1)
        words = self.words.scalar()
        for number in range(len(self.levels), 0, -1):
            found = F.when(takes(words, self.levels[number - 1], number, key), found).otherwise(number % 2 == 0)
        return found


def takes(words: Column, level: Level, number: int, key: Column) -> Column:
    """Whether a level takes a key in, rightly or by mistake."""
    hit = F.lit(True)
    for k in range(level.hashes):
        at = position(key, number, k, level.bits)
        word = F.get(words, (F.shiftright(at, 6) + level.offset).cast("int"))
        hit = hit & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return hit


def position(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(k), key), F.lit(bits).cast("long"))


def size_level(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of n keys with a rate of mistakes."""
    rate = min(0.5, max(rate, 1e-12))
    bits = math.ceil(n * -math.log(rate) / math.log(2) ** 2)
    return 64 * max(1, math.ceil(bits / 64)), max(1, round(-math.log2(rate)))


def level_words(spark: SparkSession, keys: DataFrame, number: int, level: Level) -> DataFrame:
    """One row: the level's words in order. Bits of a word are joined before the shuffle."""
    n_words = level.bits // 64
    at = keys.select(F.explode(F.array(*(position(F.col("key"), number, k, level.bits) for k in range(level.hashes)))).alias("at"))
    some = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    none = spark.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = lambda x, by: F.array_sort(F.collect_list(F.struct(by, x)))
    chunks = words.groupBy(F.expr(f"word div {CHUNK}").alias("chunk")).agg(ordered("bits", "word").alias("parts"))
    chunks = chunks.select("chunk", F.transform("parts", lambda p: p["bits"]).alias("bits"))
    return chunks.agg(ordered("bits", "chunk").alias("parts")).select(F.flatten(F.transform("parts", lambda p: p["bits"])).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """The cascade of the listed keys over a universe (columns ``key``, distinct); None if it had over max_bits bits.

    Keys that the universe doesn't hold are left out. Each level's keys are half of those two levels above, on
    average, so all levels together read little more than the universe once.
    """
    spark = universe.sparkSession
    mine = cut_lineage(universe.join(listed.select("key").distinct(), "key", "left_semi"))
    n, others = mine.count(), universe.count()
    others -= n
    empty = spark.createDataFrame([([],)], "words array<long>")
    if not n:
        return Cascade(empty, ())
    levels: list[Level] = []
    arrays: list[DataFrame] = []
    encoded, open_, offset, tested = mine, universe, 0, others
    while n:
        number = len(levels) + 1
        if number > MAX_LEVELS:
            raise ValueError("two keys of the universe have equal hashes at every level")
        rate = math.sqrt(0.5) * n / max(1, others) if number == 1 else 0.25 / tested if number > 2 and n <= FEW else 0.5
        level = Level(offset, *size_level(n, rate))
        offset += level.bits // 64
        if 64 * offset > max_bits:
            return None
        levels.append(level)
        own = cut_lineage(level_words(spark, encoded, number, level))
        arrays.append(own)
        wrong = open_.filter(takes(own.scalar(), level._replace(offset=0), number, F.col("key")))
        if number == 1:
            wrong = wrong.join(mine, "key", "left_anti")
        wrong = cut_lineage(wrong)
        encoded, open_, n, tested = wrong, encoded, wrong.count(), n
    joined = arrays[0].select(F.concat("words", *(a.scalar() for a in arrays[1:])).alias("words"))
    return Cascade(cut_lineage(joined), tuple(levels))


def list_keys(entries: DataFrame) -> DataFrame:
    """entries (host, path) as key, labels and chars."""
    host = F.translate("host", _UPPER, _LOWER)
    path = F.coalesce("path", F.lit(""))
    good = entries.filter("host <> ''").filter((path == "") | path.startswith("/"))
    return good.select(
        F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"), *(c for c in ("action",) if c in entries.columns)
    )


def shapes_of(keys: DataFrame) -> list[Shape]:
    """The distinct shapes: at most (labels of a host) * (characters of a path), however many entries."""
    return sorted((r["labels"], r["chars"]) for r in keys.select("labels", "chars").distinct().collect())


def candidate(host: str, path: str, shape: Shape) -> Column:
    """The key that a url has for a shape; null if it has none."""
    labels, chars = shape
    fits = (F.col(host) != "") & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def match(df: DataFrame, host: str, path: str, keys: DataFrame, out: str, max_bits: int = MAX_BITS) -> DataFrame:
    """df with ``out``: the longest listed key that fits, or null."""
    shapes = shapes_of(keys)
    if not shapes:
        return df.withColumn(out, F.lit(None).cast("string"))
    names = free_names(df, *(f"_key{k}" for k in range(len(shapes))))
    hosts = df.select(host, path)
    universe = hosts.select(F.explode(F.array(*(candidate(host, path, s) for s in shapes))).alias("key")).filter("key IS NOT NULL")
    cascade = build_cascade(keys, cut_lineage(universe.distinct()), max_bits)
    wide = df.withColumns({n: candidate(host, path, s) for n, s in zip(names, shapes)})
    if cascade is None:
        for name in names:
            right = keys.select(F.col("key").alias(f"{name}_")).distinct()
            wide = wide.join(right, F.col(name) == F.col(f"{name}_"), "left").drop(name).withColumnRenamed(f"{name}_", name)
        found = {n: F.col(n).isNotNull() for n in names}
    else:
        found = {n: F.col(n).isNotNull() & cascade.contains(F.col(n)) for n in names}
    ranked = [
        F.when(listed, F.struct(F.length(n).alias("width"), F.lit(labels).alias("labels"), F.col(n).alias("key")))
        for (n, listed), (labels, _) in zip(found.items(), shapes)
    ]
    return wide.withColumn(out, (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["key"]).drop(*names)


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """pages with ``host``, ``path``, ``rule``, ``listed`` (the block list's longest fitting key) and ``verdict``.

    rules: host, path, action; blocked: host, path.
    """
    outputs = {"host", "path", "rule", "listed", "verdict"}
    df = pages.withColumns({"_url": F.col(url)}).drop(*(c for c in pages.columns if c.lower() in outputs))
    df = df.withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))}).drop("_url")
    keys = cut_lineage(list_keys(rules))
    df = match(df, "host", "path", keys, "rule", max_bits)
    blocks = keys.filter("action = 'block'").select("key").distinct()
    told = build_cascade(blocks, cut_lineage(keys.select("key").distinct()), max_bits)
    df = match(df, "host", "path", cut_lineage(list_keys(blocked)), "listed", max_bits)
    if told is None:
        right = blocks.select(F.col("key").alias("_blocks"))
        df = df.join(right, F.col("rule") == F.col("_blocks"), "left")
        by_rule = F.col("_blocks").isNotNull()
    else:
        by_rule = told.contains(F.col("rule"))
    block = F.when(F.col("rule").isNotNull(), by_rule).otherwise(F.col("listed").isNotNull())
    return df.withColumn("verdict", F.when(block, "block").otherwise("allow")).drop("_blocks")


def hosts_with(pages: DataFrame, words: tuple[str, ...], url: str = "url") -> DataFrame:
    """A block list made from the corpus: its hosts with one of the words in a label (labels are cut at ``-``)."""
    hosts = pages.select(url_host(F.col(url)).alias("host")).distinct()
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words)))
    return hosts.filter(bad).withColumn("path", F.lit(""))
