"""Raw posts: XML files of users' activity, read by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import vocabulary as V
from textloom.operators.features import single_mood

#: One <posts> block: a user's activity. Tags that are absent are null.
SCHEMA = """post ARRAY<STRUCT<user: STRING, itemid: STRUCT<int: INT>, event: STRUCT<string: STRING, base64: STRING>,
 event_timestamp: STRUCT<int: BIGINT>, current_moodid: ARRAY<STRUCT<int: INT>>, current_mood: STRUCT<string: STRING>>>"""


#: Spark's newer XML parser ends at the first document of a file; this one reads all that follow one another.
WHOLE_FILE = {"useLegacyXMLParser": "true"}


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """One row a post: file, user, item_id, text, posted_at, mood_id, custom_mood.

    Files may hold several documents one after the other. A post without a text keeps its row with a null text;
    a post with no or several mood ids has a null mood_id. Many small files are packed into one task by Spark.
    """
    blocks = spark.read.format("xml").options(rowTag="posts", **WHOLE_FILE).schema(SCHEMA).load(path)
    return rows_of(blocks.select(F.col("_metadata.file_name").alias("_name"), "post"))


def rows_of(blocks: DataFrame) -> DataFrame:
    """One row a post from blocks (_name, post)."""
    rows = blocks.select(bare_name("_name").alias("file"), F.posexplode("post").alias("pos", "p"))
    mood = single_mood(F.filter("p.current_moodid", lambda m: F.lit(True)))
    return rows.select(
        "file",
        F.col("pos").cast("long").alias("pos"),
        F.col("p.user").alias("user"),
        F.col("p.itemid.int").alias("item_id"),
        T.clean_markup(F.col("p.event.string")).alias("text"),
        F.col("p.event_timestamp.int").alias("posted_at"),
        mood["int"].alias("mood_id"),
        F.col("p.current_mood.string").alias("custom_mood"),
    )


def read_posts_strict(spark: SparkSession, path: str) -> DataFrame:
    """(user, text) of files whose <post> elements each have exactly one user and one event text; others are an error.

    The error comes when the rows are read. Entities are decoded, then markup goes.
    """
    schema = "user ARRAY<STRING>, event ARRAY<STRUCT<string: STRING>>"
    rows = spark.read.format("xml").options(rowTag="post", **WHOLE_FILE).schema(schema).load(path)
    whole = (F.size("user") == 1) & (F.size(F.filter("event", lambda e: e["string"].isNotNull())) == 1)
    checked = rows.withColumn("_ok", F.when(whole, True).otherwise(F.raise_error(F.lit("a post needs one user and one event text"))))
    return checked.filter("_ok").select(F.col("user")[0].alias("user"), T.clean_markup(F.col("event")[0]["string"]).alias("text"))


def bare_name(name: str, extension: str = "xml") -> Column:
    """A file's name without its extension: the external name of a user's file."""
    return F.regexp_extract(F.col(name), rf"^(.*?)(\.{extension})?$", 1)


def number_names(paths: DataFrame) -> DataFrame:
    """(user_id, user): the distinct names at the end of paths (column path), without .xml, numbered from 1 by name.

    Names are ranked in range partitions, so no task holds all of them.
    """
    named = paths.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(?s)^(.*?)(\.xml)?$", 1).alias("word"))
    numbered = V.number(named.distinct().withColumn("cnt", F.lit(1)))
    return numbered.select(F.col("word_id").alias("user_id"), F.col("word").alias("user"))


def user_names(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, user): names of the files of a folder, numbered by name."""
    return number_names(spark.read.format("binaryFile").load(path).select("path"))


def locate_posts(posts: DataFrame, users: DataFrame) -> DataFrame:
    """posts (file, start, …) with the user of the span (file, start, stop, user) that holds their start.

    Spans of a file don't overlap, so a post's span is the last that began before it: spans and posts are ordered
    together and the last user is carried on, in slices of a file of about a million offsets.
    """
    width = 1_000_000
    piece = F.floor(F.col("start") / width).cast("long")
    marks = users.select(
        "file", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("stop") / width).cast("long"))).alias("piece"),
        F.col("start").alias("at"), F.struct("stop", "user").alias("span"),
    )
    others = [c for c in posts.columns if c != "user"]
    rows = posts.select(*others, piece.alias("piece"), F.col("start").alias("at"), F.lit(True).alias("is_post"))
    both = rows.unionByName(marks.withColumn("is_post", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("file", "piece").orderBy("at", "is_post").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("span", F.last("span", ignorenulls=True).over(order)).filter("is_post")
    return carried.select(*others, F.when(F.col("at") <= F.col("span.stop"), F.col("span.user")).alias("user"))
