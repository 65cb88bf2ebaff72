"""Mini-batches of a Parquet folder: files in a seeded order, rows in batches of a fixed size, the same on every run.

A row's number is its file's offset (the rows of the files before it in the seeded order) plus its place in the file, and its batch
is that number by the size. Places come with the scan and files are counted once, so no row is shuffled; a batch spans the end
of a file and the start of the next. first and last choose a range of files in their order by name, before the order is seeded.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.vocabulary import BROADCAST_BYTES, table_bytes
from textloom.session import cut_lineage


def mini_batches(spark: SparkSession, path: str, size: int, seed: int = 0, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows of path with ``batch`` (from 0) and ``row`` (from 0, in the order of the batches).

    last is the first file that is left out; without it all files from first on are taken.
    """
    rows = spark.read.parquet(path)
    taken = {c.lower() for c in rows.columns}
    if clash := taken & {"batch", "row", "_file", "_place"}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    # A row a file: names and counts, ordered in one task.
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    named = files.withColumn("_k", F.row_number().over(Window.orderBy("_file")) - 1).filter(F.col("_k") >= first)
    chosen = named if last is None else named.filter(F.col("_k") < last)
    name = F.element_at(F.split("_file", "/"), -1)
    seeded = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), name)), "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(chosen.select("_file", F.coalesce(F.sum("_n").over(seeded), F.lit(0)).alias("_offset")))
    small = table_bytes(offsets) <= BROADCAST_BYTES
    met = rows.join(F.broadcast(offsets) if small else offsets, "_file")
    number = (F.col("_offset") + F.col("_place")).cast("long")
    return met.withColumns({"row": number, "batch": F.floor(number / size).cast("long")}).drop("_file", "_place", "_offset")


def each_batch(batches: DataFrame, first: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """Number and rows of each batch from first on; a reader that stopped goes on where it was."""
    top = batches.agg(F.max("batch")).first()[0]
    for k in range(first, -1 if top is None else top + 1):
        yield k, batches.filter(F.col("batch") == k).drop("batch").orderBy("row").drop("row")
