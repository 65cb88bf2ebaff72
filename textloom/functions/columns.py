"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def exploded(rows: DataFrame, keep: list[str | Column], array: Column, name: str = "word") -> DataFrame:
    """keep and a row for each element of a computed array, nulls left out.

    Below an inner explode Spark puts a test of the array, which makes it again, twice; below an outer one it can't.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def sample_share(key: str | Column, share: float, seed: int = 94720) -> Column:
    """Whether a key falls into a reproducible sample: the same rows on every run and any cluster."""
    column = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") < int(share * (1 << 32))
