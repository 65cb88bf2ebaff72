"""What the operators of this subpackage share: the word pattern, small column helpers and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, however often the lambda mentions it."""
    return F.transform(F.array(value), use)[0]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened until df has no such column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def arrow_batches(spark: SparkSession, rows: int = 256, max_bytes: str = "8m") -> None:
    """Keep Arrow batches small: documents may be long, and an executor's memory is shared by its tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", max_bytes)


def pooled(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_bytes, so that what a batch's rows share is worked out less often."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= max_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def split_words(column: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a batch of texts: the distinct ones, the place of each word among them, and each text's number."""
    column = column.cast(pa.large_string()).fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    coded = flat.filter(some).dictionary_encode()
    lengths = np.diff(upto[offsets - offsets[0]]) if len(column) else np.zeros(0, np.int64)
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), lengths
