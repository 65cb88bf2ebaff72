"""Text, CSV and Parquet sources and sinks: taxonomies, word vectors, sentences, vocabularies and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.moods import complete


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files give fewer tasks than there are cores, as one small file does.

    Large inputs have more parts than that and stay as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_moods(spark: SparkSession, path: str, header: bool = True, line_end: str = "\r") -> DataFrame:
    """(mood_id, mood, level, parent_id, parent) or (mood_id, mood), by how many columns the file has.

    With a header the missing ids are added; without one, as for search, -1 is added as N/A.
    """
    rows = spark.read.option("lineSep", line_end).text(path)
    cells = F.split(F.trim("value"), ",")
    parsed = rows.select(cells.alias("c")).filter(F.col("c")[0].rlike(r"^-?[0-9]+$"))
    text = lambda i: F.nullif(F.trim(F.get("c", F.lit(i))), F.lit(""))
    moods = parsed.select(
        text(0).cast("int").alias("mood_id"), text(1).alias("mood"), text(2).try_cast("int").alias("level"),
        text(3).try_cast("int").alias("parent_id"), text(4).alias("parent"),
    )
    if header:
        return complete(moods).orderBy("mood_id")
    extra = spark.createDataFrame([(-1, "N/A")], "mood_id int, mood string")
    return moods.select("mood_id", "mood").unionByName(extra)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from lines of a word and its numbers, parted by spaces; a first line of two numbers is a header."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*[0-9]+ [0-9]+\s*$") & F.col("value").contains(" "))
    parts = lines.select(F.substring_index("value", " ", 1).alias("word"), F.split(F.trim(F.expr("substring(value, instr(value, ' ') + 1)")), " +").alias("v"))
    return parts.select("word", F.col("v").cast("array<double>").alias("vector"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    numbers = F.array_join(F.col("vector").cast("array<string>"), " ")
    vectors.select(F.concat_ws(" ", "word", numbers).alias("value")).write.mode("overwrite").text(path)


def write_sentences(rows: DataFrame, path: str, words: str = "words", user: str | None = None) -> None:
    """A sentence a line, words joined by spaces; with user, its mark is put in."""
    shown = F.col(words) if user is None else T.inject_ids(words, F.concat(F.lit("USER_"), F.col(user).cast("string")))
    rows.select(F.array_join(shown, " ").alias("value")).write.mode("overwrite").text(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    value = F.trim("value")
    return spark.read.text(path).select(F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, " +")).alias("words"))


def write_words(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select(F.col("word").alias("value")).write.mode("overwrite").text(path)


def words_line(vocabulary: DataFrame) -> DataFrame:
    """All words in one line by word_id, as some tools want it. One row: for vocabularies of a bounded size."""
    words = F.array_sort(F.collect_list(F.struct("word_id", "word")))
    return vocabulary.agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("value"))


def write_table(df: DataFrame, path: str, rows_per_file: int = 500_000, by: str | None = None, codec: str = "zstd") -> None:
    """Parquet files of a bounded number of rows."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_metrics(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").option("header", "true").format(form).save(path)
