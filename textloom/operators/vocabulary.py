"""Vocabularies: counted, merged, trimmed and numbered words. A vocabulary has the columns word, word_id, cnt."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.columns import exploded
from textloom.session import cut_lineage

#: So many words may be ranked in one task.
BOUNDED = 2_000_000
#: Tables of up to so many bytes are broadcast to rows that are joined with them.
BROADCAST_BYTES = 256 << 20
SALTS = 32


def table_bytes(table: DataFrame) -> int:
    """About what a table takes in memory: text and arrays by their lengths, 16 bytes for other values and a row's head."""
    size = F.lit(64).cast("long")
    for field in table.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            size = size + 8 * F.greatest(F.size(column), F.lit(0))
        elif isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        else:
            size = size + 16
    return table.agg(F.sum(size)).first()[0] or 0


def join_words(rows: DataFrame, table: DataFrame, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with a table that has one row a word. The table is made once and weighed: one of at most ``most`` bytes
    is broadcast, so no row is shuffled; a larger one is copied to SALTS salts, over which the rows of a frequent word are
    spread."""
    table = cut_lineage(table)
    if table_bytes(table) <= most:
        return rows.join(F.broadcast(table), "word", how)
    others = [c for c in rows.columns if c != "word"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["word", "_salt"], how).drop("_salt")


def count_words(posts: DataFrame, words: str = "words") -> DataFrame:
    """(word, cnt) over all posts; counts are combined before the shuffle."""
    return exploded(posts, [], F.col(words)).groupBy("word").agg(F.count("*").alias("cnt"))


def merge(*counts: DataFrame) -> DataFrame:
    """The union of (word, cnt) tables, counts added up."""
    both = reduce(DataFrame.unionByName, (c.select("word", "cnt") for c in counts))
    return both.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def trim(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("cnt") >= least)


def keep_most(counts: DataFrame, most: int) -> DataFrame:
    """The words of at least the smallest count that leaves no more than `most` of them.

    Counts with fewer words than that above them are found in the histogram of counts, which has a row for each
    distinct count; the counted words are shuffled once, as the plan uses their exchange again.
    """
    by_count = counts.groupBy("cnt").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0))
    kept = by_count.select("cnt", above.alias("above")).filter(F.col("above") <= most)
    return counts.join(kept.select("cnt"), "cnt", "left_semi")


def number(counts: DataFrame, most: int | None = None) -> DataFrame:
    """word_id from 1 by falling count, then word.

    Up to BOUNDED words (proven by most) are ranked in one task. More are sorted into range partitions, ranked in
    each, and moved up by the sizes of the partitions before.
    """
    order = (F.desc("cnt"), F.asc("word"))
    if most is not None and most <= BOUNDED:
        ranked = counts.withColumn("word_id", F.row_number().over(Window.orderBy(*order)))
        return ranked.select("word", F.col("word_id").cast("long").alias("word_id"), F.col("cnt").cast("long").alias("cnt"))
    n = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = counts.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select(
        "word", (F.col("k") + F.col("before")).cast("long").alias("word_id"), F.col("cnt").cast("long").alias("cnt")
    )


def from_counts(counts: DataFrame, most: int | None = 1_000_000, least: int = 1) -> DataFrame:
    kept = trim(counts, least) if least > 1 else counts
    return number(keep_most(kept, most) if most is not None else kept, most)


def build(posts: DataFrame, most: int | None = 1_000_000, least: int = 1, words: str = "words") -> DataFrame:
    """The vocabulary of posts: counts of all of them, then trimmed by one threshold to at most `most` words."""
    return from_counts(count_words(posts, words), most, least)


def first_words(posts: DataFrame, n: int, words: str = "words") -> DataFrame:
    """The vocabulary's first n words by falling count, then word: others are counted but never numbered."""
    counts = count_words(posts, words)
    if n > BOUNDED:
        return number(counts).filter(F.col("word_id") <= n)
    return number(counts.orderBy(F.desc("cnt"), "word").limit(n), n)


def top(vocabulary: DataFrame, n: int) -> DataFrame:
    """The n most frequent words."""
    return vocabulary.filter(F.col("word_id") <= n)


def encode(tokens: DataFrame, vocabulary: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """(…, word) rows with word_id; words outside the vocabulary go, or stay with a null word_id."""
    return join_words(tokens, vocabulary.select("word", "word_id"), "left" if keep_unknown else "inner")


def known_words(posts: DataFrame, vocabulary: DataFrame, key: str = "post_id", words: str = "words", most: int = BROADCAST_BYTES) -> DataFrame:
    """posts with only the words of the vocabulary, in order; posts without any go.

    A vocabulary of at most ``most`` bytes is sent to the tasks, which filter each row's array: nothing is shuffled. A
    larger one is joined, and words are put together again by a row number that the scan gives.
    """
    own = cut_lineage(vocabulary.select("word"))
    if table_bytes(own) > most:
        return _joined_words(posts, vocabulary, words)
    shared = posts.sparkSession.sparkContext.broadcast(own.toArrow()["word"].combine_chunks())

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            flat = batch.flatten().dictionary_encode()
            stays = pc.is_in(flat.dictionary, value_set=known.cast(flat.dictionary.type)).to_numpy(zero_copy_only=False)
            mask = stays[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, bool)
            upto = np.concatenate([[0], np.cumsum(mask)])
            offsets = upto[np.concatenate([[0], np.cumsum(lengths)])]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(mask)).dictionary_decode())

    keep.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not deterministic: else the filter below would run it twice.
    filtered = F.arrow_udf(keep, "array<string>").asNondeterministic()(F.col(words))
    return posts.withColumn(words, filtered).filter(F.size(words) > 0)


def _joined_words(posts: DataFrame, vocabulary: DataFrame, words: str) -> DataFrame:
    others = [c for c in posts.columns if c != words]
    rows = cut_lineage(posts.withColumn("_row", F.monotonically_increasing_id()))
    flat = rows.select("_row", *others, F.posexplode(words).alias("pos", "word"))
    kept = encode(flat, vocabulary)
    grouped = kept.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in others), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w")
    )
    return grouped.select(*others, F.transform("_w", lambda x: x["word"]).alias(words))
