"""A folder of XML posts, tokenised file by file as files arrive.

A stream's checkpoint is the list of what is done: a run takes the files that no earlier run has taken and ends. Each
micro-batch writes its tokens (with the file they came from) and its files' word counts to folders named by the batch, over
what a broken attempt left there, so every file counts once. The dictionary is the sum of all files' counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import vocabulary as V
from textloom.sources.posts import SCHEMA, WHOLE_FILE, rows_of


def tokenise_new(spark: SparkSession, source: str, target: str, files_a_batch: int = 1000) -> int:
    """Tokenise the files of source that aren't done yet; gives how many rows of posts this run has read."""
    options = {"rowTag": "posts", "maxFilesPerTrigger": str(files_a_batch), "pathGlobFilter": "*.xml", **WHOLE_FILE}
    blocks = spark.readStream.format("xml").options(**options).schema(SCHEMA).load(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = rows_of(batch).filter(F.col("text").isNotNull())
        tokens = rows.select("file", "pos", "user", "item_id", "mood_id", T.words("text").alias("words"))
        tokens.write.mode("overwrite").parquet(f"{target}/tokens/batch={number}")
        done = spark.read.parquet(f"{target}/tokens/batch={number}")
        counts = done.select("file", F.explode("words").alias("word")).groupBy("file", "word").agg(F.count("*").alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{target}/counts/batch={number}")

    # The file's name is part of the stream's rows: metadata isn't there any more once a batch has been made.
    named = blocks.select(F.col("_metadata.file_name").alias("_name"), "post")
    run = named.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def tokens(spark: SparkSession, target: str) -> DataFrame:
    """Posts with their words: file, pos, user, item_id, mood_id, words."""
    return spark.read.parquet(f"{target}/tokens").drop("batch")


def dictionary(spark: SparkSession, target: str, most: int | None = 1_000_000, least: int = 1) -> DataFrame:
    """The vocabulary of all files done so far."""
    return V.from_counts(V.merge(spark.read.parquet(f"{target}/counts")), most, least)
