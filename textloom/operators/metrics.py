"""Metrics on predictions, and covariance. Scored tables have a score (probability) and a label of 0 or 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-7  # fixed value: keeps the logarithm finite


def auc(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(keys, positives, negatives, auc): the exact area under the ROC curve, equal scores counting half.

    Rows of equal scores are counted before they are ordered: the area is the sum over scores of
    negatives * (positives above + half of the positives there). Sums over scores below come from two levels, the
    scores' leading digits and the scores within one of these, so no task orders all of them.
    """
    flags = F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    by_score = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(*flags)
    by_score = by_score.withColumn("part", F.floor(F.col("s") * 1000))
    parts = by_score.groupBy(*keys, "part").agg(F.sum("p").alias("pp"))
    above = F.coalesce(F.sum("pp").over(Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("part").alias("_part"), above.alias("above"))
    on = by_score["part"] == parts["_part"]
    for k in keys:
        on = on & by_score[k].eqNullSafe(parts[f"_{k}"])
    within = F.coalesce(F.sum("p").over(Window.partitionBy(*keys, "part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = by_score.join(parts, on).withColumn("higher", F.col("above") + within)
    area = F.sum(F.col("n").cast("double") * (F.col("higher") + F.col("p") / 2))
    positives, negatives = F.sum("p"), F.sum("n")
    return placed.groupBy(*keys).agg(
        positives.alias("positives"), negatives.alias("negatives"),
        F.round(area / F.nullif(positives.cast("double") * negatives, F.lit(0.0)), 6).alias("auc"),
    )


def roc_curve(scored: DataFrame, points: int = 100, score: str = "score", label: str = "label") -> DataFrame:
    """(k, tpr, fpr) at the thresholds k / points: a histogram of scores, then its running sums (points + 1 rows)."""
    bins = scored.groupBy(F.least(F.floor(F.col(score) * points), F.lit(points)).cast("long").alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = lambda c: F.round(F.sum(c).over(down) / F.nullif(F.sum(c).over(whole), F.lit(0)), 6)
    return bins.select("k", rate("p").alias("tpr"), rate("n").alias("fpr"))


def agreement(score: Column, label: Column) -> Column:
    """How far a probability agrees with its label."""
    return label * score + (1 - label) * (1 - score)


def log_likelihood(score: Column, label: Column) -> Column:
    return F.avg(F.log(F.lit(EPSILON) + agreement(score, label)))


def soft_accuracy(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Mean agreement, mean over classes weighted by their share, and the log-likelihood."""
    s, y = F.col(score), F.col(label)
    a = agreement(s, y)
    positive, negative = F.avg(F.when(y == 1, a)), F.avg(F.when(y == 0, a))
    return scored.groupBy(*keys).agg(
        F.round(F.avg(a), 6).alias("accuracy"),
        F.round((F.coalesce(positive, F.lit(0.0)) + F.coalesce(negative, F.lit(0.0))) / (F.nullif(F.countDistinct(y), F.lit(0))), 6).alias("balanced"),
        F.round(log_likelihood(s, y), 6).alias("loglik"),
    )


def confusion(rows: DataFrame, true: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n, share): share is of the label's rows. Counts are few, so ranking them is cheap."""
    counts = rows.groupBy(F.col(true).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


def accuracy(matrix: DataFrame) -> DataFrame:
    """Overall (weighted by class) and mean diagonal accuracy of a confusion table."""
    right = F.col("label") == F.col("predicted")
    return matrix.agg(
        F.round(F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("weighted"),
        F.round(F.sum(F.when(right, F.col("share")).otherwise(0.0)) / F.countDistinct("label"), 6).alias("mean_diagonal"),
    )


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def post_scores(sentences: DataFrame, keys: Sequence[str], score: str = "score", how: str = "max") -> DataFrame:
    """Sentence scores to post scores by maximum or mean."""
    agg = {"max": F.max, "mean": F.avg}[how]
    return sentences.groupBy(*keys).agg(F.round(agg(score), 6).alias("score"))


def best_and_worst(rows: DataFrame, name: str, value: str) -> DataFrame:
    """The names with the highest and the lowest value; of equals the smallest name."""
    return rows.agg(
        F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("best"),
        F.min_by(name, F.struct(F.col(value), F.col(name))).alias("worst"),
    )


def covariance(rows: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, kind: str = "cov") -> DataFrame:
    """(x, y, value): sample covariance or correlation of each pair of columns, in one aggregation."""
    pairs = [(a, b) for a in left for b in (right if right is not None else left)]
    fn = {"cov": F.covar_samp, "corr": F.corr}[kind]
    one = rows.agg(*(fn(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.col(f"c{i}"), 6).alias("value")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(cells))


def gram(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, value): centred products divided by the number of rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.col(f"c{i}"), 6).alias("value")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(cells))
