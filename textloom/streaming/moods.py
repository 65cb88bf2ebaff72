"""Mood counts and vocabularies kept up to date from a stream of posts or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as T
from textloom.functions.columns import exploded


def mood_windows(events: DataFrame, width: str = "1 day", late: str = "1 day", time: str = "ts", mood: str = "event_type") -> DataFrame:
    """(start, mood, n): events of each mood in tumbling windows; the watermark bounds the state."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    counts = timed.groupBy(F.window(time, width).alias("w"), F.col(mood).alias("mood")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "mood", "n")


def word_counts(posts: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt) so far: a running aggregation whose state is a row for each word."""
    return exploded(posts, [], T.words(text)).groupBy("word").agg(F.count("*").alias("cnt"))


def write_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a query that reads what is there and ends; batches are written once each."""
    writer = counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")).start()
