"""Connected components of a graph of links, by large-star and small-star rounds on DataFrames.

Each round rewrites every link to point at smaller nodes; a node's links are grouped by key only for their
minimum, which is combined before the shuffle, and get it back through a salted join, so that the members of a large
component don't meet in one task. Rounds stop when nothing changes. Links stay distributed and are checkpointed, so
lost executors cost at most one round. Links with a null end are no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def attach(rows: DataFrame, classes: DataFrame, key: str, spread: str, salts: int = 32) -> DataFrame:
    """rows joined with the class of their key. A key that very many rows share is salted by the column spread: its
    class row is copied to the salts that its own rows use, so no task holds them all."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    used = salted.select(key, "_salt").distinct()
    return salted.join(used.join(classes, key), [key, "_salt"]).drop("_salt")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large star: a node's greater neighbours move to its least one; small star: the others do."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = attach(both.filter("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = attach(links, least, "a", "b")
        moved = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b: any order, one type that compares) to (node, root): root is the least node reachable, for
    every node that has a link."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    current = cut_lineage(ordered)
    state = _state(current)
    while state[0]:
        current = cut_lineage(_star(_star(current, large=True), large=False))
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
