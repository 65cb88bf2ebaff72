"""Mood taxonomies: ids, names and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids that the taxonomy leaves out, and their names.
MISSING = {0: "empty", 50: "invalid", 94: "invalid2"}
# The moods of each of 15 groups.
GROUPS = (
    (122, 35, 15, 125, 131, 66, 72, 99, 21, 26, 93, 109, 126, 13, 32, 42, 67, 70, 105, 115, 116, 117, 121),
    (62, 98),
    (10, 11, 41, 52, 59, 120, 55, 123, 65, 17, 36, 44, 96),
    (101, 85, 69, 87, 89, 16, 45, 56, 73, 88, 128),
    (1, 3, 46, 80, 110, 118, 133, 85),
    (4, 134, 63, 104),
    (19, 20, 95, 28, 47, 100, 37),
    (2, 8, 12, 24, 23, 106, 119),
    (30, 25, 38, 39, 29),
    (127, 7, 9, 22, 124, 129, 114, 107, 43, 60, 71, 79),
    (77, 75, 5, 33, 113, 78, 103),
    (58, 57, 68, 92, 102),
    (53, 61),
    (76, 64, 86),
    (112, 91, 54, 90, 14, 31, 40, 49, 51, 132, 74, 108, 6, 18, 27, 34, 48, 81, 82, 83, 84, 97, 111, 130),
)


def complete(moods: DataFrame) -> DataFrame:
    """(mood_id, mood, …) with the missing ids added where they aren't there."""
    extra = moods.sparkSession.createDataFrame(list(MISSING.items()), "mood_id int, mood string")
    absent = extra.join(moods.select("mood_id"), "mood_id", "left_anti")
    return moods.unionByName(absent, allowMissingColumns=True)


def group_of(mood: int, cascade: bool = False) -> int:
    """The group of a mood; moods in no group keep their id, the last of several groups counts.

    With cascade, a group found is looked up again in the groups that follow, as if it were a mood.
    """
    value = mood
    for k, members in enumerate(GROUPS):
        if (value if cascade else mood) in members:
            value = k
    return value


def group_table(spark: SparkSession, cascade: bool = False) -> DataFrame:
    """(mood, mood_group) for all 132 moods: a small table to broadcast."""
    ids = sorted({m for g in GROUPS for m in g})
    return spark.createDataFrame([(m, group_of(m, cascade)) for m in ids], "mood long, mood_group long")


def grouped(rows: DataFrame, mood: str = "mood", cascade: bool = False) -> DataFrame:
    """rows with mood_group; ids outside the table keep their value."""
    table = group_table(rows.sparkSession, cascade).withColumnRenamed("mood", "_m")
    joined = rows.join(F.broadcast(table), F.col(mood) == F.col("_m"), "left")
    return joined.withColumn("mood_group", F.coalesce("mood_group", F.col(mood).cast("long"))).drop("_m")


def levels(moods: DataFrame) -> DataFrame:
    """How many moods each level of the taxonomy (mood_id, mood, level, parent_id) has."""
    return moods.groupBy("level").agg(F.count("*").alias("n"))
