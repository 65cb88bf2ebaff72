"""Term weights, label transforms and reproducible splits before learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import join_words


def square_root(bow: DataFrame) -> DataFrame:
    return bow.withColumn("weight", F.sqrt("cnt"))


def document_frequency(bow: DataFrame, key: str = "post_id") -> DataFrame:
    """(word, df). bow has one row a post and word, so rows are counted without a distinct."""
    return bow.groupBy("word").agg(F.count("*").alias("df"))


def inverse_frequency(train: DataFrame, n_posts: int | Column) -> DataFrame:
    """(word, idf): ln N - ln df over the training posts."""
    n = F.lit(n_posts) if isinstance(n_posts, int) else n_posts
    return document_frequency(train).select("word", (F.log(n.cast("double")) - F.log(F.col("df").cast("double"))).alias("idf"))


def tfidf(bow: DataFrame, idf: DataFrame) -> DataFrame:
    """bow with weight = cnt * idf; 0 for words that training never saw."""
    return join_words(bow, idf, "left").withColumn("weight", F.col("cnt") * F.coalesce("idf", F.lit(0.0))).drop("idf")


def one_hot(rows: DataFrame, label: str, labels: list) -> DataFrame:
    """A 0/1 column y_<label> for each label."""
    return rows.select("*", *(F.coalesce((F.col(label) == x).cast("int"), F.lit(0)).alias(f"y_{x}") for x in labels))


def regroup(rows: DataFrame, groups: DataFrame, label: str = "mood") -> DataFrame:
    """(…, target, weight): each row's label in new targets; groups has label, target, weight.

    A row has one line for each target of its label.
    """
    others = [c for c in rows.columns if c != label]
    return rows.join(groups, label).groupBy(*others, label, "target").agg(F.sum("weight").alias("weight"))


def split(rows: DataFrame, share: float, group: str, key: str, digits: int = 3) -> DataFrame:
    """rows with `test`: in each group, the ceil(n * share) rows whose keys have the smallest hashes.

    The first hex digits of the hash divide a group into 16**digits parts, whose counts show in which one the cut
    lies; only that part is ranked, so one task never orders a whole group. Equal hashes are ordered by key.
    """
    by = Window.partitionBy(group).orderBy("_part")
    # Text, as md5 reads it; null keys and groups count as a value of their own.
    hashed = rows.withColumn("_h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("_part", F.substring("_h", 1, digits))
    counts = hashed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_want", F.ceil(F.sum("_n").over(Window.partitionBy(group)) * F.lit(share) - 1e-9)
    )
    cut = upto.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.col("_want") - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n")
    joined = hashed.join(cut, hashed[group].eqNullSafe(cut["_g"]) & (hashed["_part"] == cut["_p"]))
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_h", key))
    inside = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    border = joined.filter(inside).withColumn("test", rank <= F.col("_left"))
    rest = joined.filter(~inside).withColumn("test", F.col("_left") > 0)
    return border.unionByName(rest).drop("_h", "_part", "_g", "_p", "_left", "_n")
