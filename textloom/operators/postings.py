"""A positional inverted index: keyword search that reads only the blocks of its words.

Layout. Rows (field, term, post, tf, length, positions) are sorted over range partitions; each partition is written to a
folder ``bucket=n`` of its own and a small table says which words it spans, so a query opens the buckets of its words, and a
prefix those of its range. A frequent word takes many buckets; no task holds all of its posts. Within a bucket up to ``BLOCK``
posts of a word are one row: posts as differences, counts, lengths and positions in as few bytes as each needs, the number of
posts, and the greatest weight sqrt(tf / length).

Search. A part of a query is a term, a phrase or a prefix, scored as in ``keyword``. A term's df is the sum of its blocks'
numbers, and nothing is decoded for it. For queries of terms that may occur, the k-th greatest block weight of one
term is a score that k posts reach; a block is left out if its own weight and the other terms' greatest together stay
below it. Other queries read all blocks of their words. Phrases are found by joining starts: a post has the phrase where all its
words agree on one. The results are those of ``keyword.search_batch``.

Keys of posts are longs that tell posts apart; posts without a key aren't found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.keyword import FIELDS, Part, Query
from textloom.session import shared_folder

BLOCK = 128
FLAT = "field string, term string, post long, tf int, length int, places array<int>"
BLOCKS = "field string, term string, n int, top double, first long, steps binary, tfs binary, lengths binary, places binary"
#: Scores are rounded to six digits: what is nearer than this may be equal.
SLACK = 1e-6


def pack(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each group of values (numbers from 0, as uint64) that begins at starts: how many bytes its numbers need (1, 2,
    4 or 8), and the numbers in so many bytes each."""
    counts = np.diff(np.append(starts, len(values)))
    width = np.array([1, 2, 4, 8])[np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32], np.uint64), np.maximum.reduceat(values, starts), "right")]
    offsets = np.concatenate([[0], np.cumsum(1 + counts * width)])
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    group = np.repeat(np.arange(len(starts)), counts)
    at = offsets[group] + 1 + (np.arange(len(values)) - starts[group]) * width[group]
    for w in (1, 2, 4, 8):
        own = np.flatnonzero(width[group] == w)
        out[at[own, None] + np.arange(w)] = values[own].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpack(body: pa.Scalar) -> np.ndarray:
    raw = body.as_buffer()
    width = raw[0]
    return np.frombuffer(raw, f"<u{width}", offset=1).astype(np.int64)


def _flat(field: str, posts: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    """A row for each post and distinct token of a batch."""
    codes = tokens.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(np.diff(tokens.offsets.to_numpy()) * tokens.is_valid().to_numpy(zero_copy_only=False))])
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - offsets[owner]
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((place, code, owner))
    owner, code, place = owner[order], code[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(owner) else np.zeros(0, int)
    ends = np.append(first, len(owner))
    columns = [
        pa.array([field] * len(first), pa.string()),
        codes.dictionary.take(pa.array(code[first])).cast(pa.string()),
        posts.take(pa.array(owner[first])),
        pa.array(np.diff(ends), pa.int32()),
        pa.array(lengths[owner[first]], pa.int32()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["field", "term", "post", "tf", "length", "places"])


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows as blocks; a block lies within one batch."""
    field, term = (batch.column(c).dictionary_encode().indices.to_numpy() for c in ("field", "term"))
    starts = np.flatnonzero(np.concatenate([[True], (field[1:] != field[:-1]) | (term[1:] != term[:-1])]))
    run = np.arange(len(field)) - np.repeat(starts, np.diff(np.append(starts, len(field))))
    starts = np.flatnonzero(run % BLOCK == 0)
    post, tf, length = (batch.column(c).to_numpy() for c in ("post", "tf", "length"))
    lists = batch.column("places")
    offsets, place = lists.offsets.to_numpy(), lists.flatten().to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    # Posts and positions as differences from the one before, from 0 at the start of a block and of a post.
    steps = np.diff(post, prepend=post[:1]).view(np.uint64)
    steps[starts] = 0
    gaps = np.diff(place, prepend=0)
    gaps[offsets[:-1]] = place[offsets[:-1]]
    weight = np.sqrt(tf.astype(float)) / np.sqrt(np.maximum(length, 1).astype(float))
    columns = [
        *(batch.column(c).take(pa.array(starts)) for c in ("field", "term")),
        pa.array(np.diff(np.append(starts, len(post))), pa.int32()),
        pa.array(np.maximum.reduceat(weight, starts)),
        pa.array(post[starts]),
        pack(steps, starts),
        *(pack(x.astype(np.uint64), starts) for x in (tf, length)),
        pack(gaps.astype(np.uint64), offsets[starts]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["field", "term", "n", "top", "first", "steps", "tfs", "lengths", "places"])


def decode(first: int, steps: pa.Scalar, tfs: pa.Scalar, lengths: pa.Scalar, places: pa.Scalar) -> tuple[np.ndarray, ...]:
    """posts, tf, length, offsets of their positions, positions."""
    tf, gaps = unpack(tfs), unpack(places)
    offsets = np.concatenate([[0], np.cumsum(tf)])
    total = np.cumsum(gaps)
    before = np.where(offsets[:-1] > 0, total[np.maximum(offsets[:-1] - 1, 0)], 0)
    return np.cumsum(unpack(steps)) + first, tf, unpack(lengths), offsets, total - np.repeat(before, tf)


class Index(NamedTuple):
    folder: str
    posts: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{self.folder}/blocks")

    def spans(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/spans")


def build_index(posts: DataFrame, folder: str | None = None, key: str = "post_id", buckets: int | None = None) -> Index:
    """posts are ``keyword.analysed``: tokens_<field> for each field to be found; they are read three times.

    buckets: range partitions and folders, as many as shuffles have by default.
    """
    spark = posts.sparkSession
    folder = folder or shared_folder(spark, "postings")
    fields = [f for f in FIELDS if f"tokens_{f}" in posts.columns]
    rows = posts.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("post"), *(f"tokens_{f}" for f in fields))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in fields:
                yield _flat(f, batch.column("post"), batch.column(f"tokens_{f}"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _blocks(batch)

    flat = rows.mapInArrow(flatten, FLAT)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = flat.repartitionByRange(buckets, "field", "term", "post").sortWithinPartitions("field", "term", "post")
    made = dealt.mapInArrow(to_blocks, BLOCKS).withColumn("bucket", F.spark_partition_id())
    made.write.partitionBy("bucket").parquet(f"{folder}/blocks")
    word = F.struct("field", "term")
    blocks = Index(folder, 0).blocks(spark)
    blocks.groupBy("bucket").agg(F.min(word).alias("first"), F.max(word).alias("last")).coalesce(1).write.parquet(f"{folder}/spans")
    n = posts.count()
    spark.createDataFrame([(n,)], "posts long").coalesce(1).write.parquet(f"{folder}/size")
    return Index(folder, n)


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(folder, spark.read.parquet(f"{folder}/size").first()["posts"])


class Search(NamedTuple):
    """blocks: those of the words, by (part, slot); least: a part's least block weight that is read."""

    parts: dict[Part, int]
    blocks: DataFrame
    df: dict[int, int]
    least: dict[int, float]


def _wanted(index: Index, spark: SparkSession, parts: dict[Part, int]) -> DataFrame:
    """part, slot (of a word in its phrase) and the blocks of all words of the parts, from the buckets that span them."""
    words = [(i, slot, p.field, w, p.prefix) for p, i in parts.items() for slot, w in enumerate(p.words[:1] if p.prefix else p.words)]
    asked = F.broadcast(spark.createDataFrame(words, "part int, slot int, _field string, word string, prefix boolean"))
    most = F.when(F.col("prefix"), F.concat("word", F.lit("\U0010ffff"))).otherwise(F.col("word"))
    low, high = F.struct(F.col("_field").alias("field"), F.col("word").alias("term")), F.struct(F.col("_field").alias("field"), most.alias("term"))
    near = index.spans(spark).join(asked, (F.col("first") <= high) & (F.col("last") >= low), "left_semi")
    buckets = sorted(r["bucket"] for r in near.select("bucket").collect())  # of the queries' words
    blocks = index.blocks(spark).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    exact = blocks.join(asked.filter("NOT prefix"), (F.col("field") == F.col("_field")) & (F.col("term") == F.col("word")))
    if not any(p.prefix for p in parts):
        return exact
    begun = blocks.join(asked.filter("prefix"), (F.col("field") == F.col("_field")) & F.col("term").startswith(F.col("word")))
    return exact.unionAll(begun)


def _idf2(posts: int, df: int) -> float:
    return (1 + math.log(max(1, posts) / (df + 1))) ** 2


def plan_search(index: Index, spark: SparkSession, queries: dict[int, list[Part]], k: int) -> Search:
    """What a batch of queries reads: only blocks' numbers and weights are looked at, a row a part comes to the driver."""
    parts = {p: i for i, p in enumerate(dict.fromkeys(replace(p, need="may") for q in queries.values() for p in q))}
    blocks = _wanted(index, spark, parts)
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("top")))
    kth = blocks.select("part", "top", place.alias("k")).filter(F.col("k") <= k).groupBy("part").agg(F.max("k").alias("k"), F.min("top").alias("kth"))
    sums = blocks.groupBy("part").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    found = {r["part"]: r for r in sums.join(kth, "part").collect()}
    single = {i for p, i in parts.items() if len(p.words) == 1 and not p.prefix}
    df = {i: found[i]["n"] if i in found else 0 for i in single}
    least: dict[int, float] = {}
    for own in queries.values():
        ids = [parts[replace(p, need="may")] for p in own]
        known = [i for i in ids if i in found]
        skips = set(ids) <= single and all(p.need == "may" for p in own)
        idf2 = {i: _idf2(index.posts, df[i]) for i in known} if skips else {}
        # A part that stands twice weighs twice; k blocks hold k posts that reach the weight of the least of them.
        most = {i: known.count(i) * idf2[i] * found[i]["top"] for i in idf2}
        sure = max((known.count(i) * idf2[i] * found[i]["kth"] for i in idf2 if found[i]["k"] == k), default=0.0)
        for i in set(known):
            if not skips:
                least[i] = 0.0
                continue
            need = sure - SLACK - sum(m for j, m in most.items() if j != i)
            least[i] = min(least.get(i, math.inf), max(0.0, need / (known.count(i) * idf2[i])) if idf2[i] > 0 else 0.0)
    return Search(parts, blocks, df, least)


def _read(search: Search, spark: SparkSession) -> DataFrame:
    """part, slot, post, tf, length, starts (positions less the slot) from the blocks that are read."""
    limits = F.broadcast(spark.createDataFrame(list(search.least.items()), "part int, least double"))
    blocks = search.blocks.join(limits, "part").filter(F.col("top") >= F.col("least") * (1 - 1e-12))
    spots = {i for p, i in search.parts.items() if len(p.words) > 1 and not p.prefix}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = zip(*(batch.column(c).to_pylist() for c in ("part", "slot", "first")))
            for k, (part, slot, first) in enumerate(ids):
                posts, tf, length, offsets, places = decode(first, *(batch.column(c)[k] for c in ("steps", "tfs", "lengths", "places")))
                n = len(posts)
                starts = (offsets, places - slot) if part in spots else (np.zeros(n + 1, int), places[:0])
                lists = pa.ListArray.from_arrays(pa.array(starts[0], pa.int32()), pa.array(starts[1], pa.int32()))
                columns = [pa.array(np.full(n, part), pa.int32()), pa.array(posts), pa.array(tf), pa.array(length), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "post", "tf", "length", "starts"])

    slim = blocks.select("part", "slot", "first", "steps", "tfs", "lengths", "places")
    return slim.mapInArrow(run, "part int, post long, tf long, length long, starts array<int>")


def search_index(index: Index, spark: SparkSession, queries: Sequence[Query], k: int = 10, key: str = "post_id") -> DataFrame:
    """(query_id, key, score, rank): the k best posts of each query."""
    own = {i: [p for p in q if p is not None] for i, q in enumerate(queries)}
    own = {i: q for i, q in own.items() if any(p.need != "not" for p in q)}
    none = spark.createDataFrame([], f"query_id long, {key} long, score double, rank long")
    if not own:
        return none
    search = plan_search(index, spark, own, k)
    if not search.least:
        return none
    rows = _read(search, spark)
    several = {i for p, i in search.parts.items() if i not in search.df}
    phrases = {p: i for p, i in search.parts.items() if i in several and not p.prefix}
    whole = rows.filter(~F.col("part").isin(list(several))).select("part", "post", "tf", "length") if several else rows.select("part", "post", "tf", "length")
    df = dict(search.df)
    if several:
        begun = rows.filter(F.col("part").isin([i for i in several if i not in phrases.values()]))
        found = begun.groupBy("part", "post").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        if phrases:
            sizes = F.create_map(*(F.lit(x) for p, i in phrases.items() for x in (i, len(p.words))))
            starts = rows.filter(F.col("part").isin(list(phrases.values()))).select("part", "post", "length", F.explode("starts").alias("start"))
            agree = starts.groupBy("part", "post", "start").agg(F.count("*").alias("n"), F.max("length").alias("length"))
            agree = agree.filter(F.col("n") == sizes[F.col("part")])
            found = found.unionAll(agree.groupBy("part", "post").agg(F.count("*").alias("tf"), F.max("length").alias("length")))
        df |= {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
        whole = whole.unionByName(found)
    return rank_parts(whole, search.parts, own, index.posts, df, k, key)


def rank_parts(rows: DataFrame, parts: dict[Part, int], queries: dict[int, list[Part]], posts: int, df: dict[int, int], k: int, key: str) -> DataFrame:
    """The k best posts of each query from rows (part, post, tf, length) of its parts; df counts a part's posts."""
    spark = rows.sparkSession
    number = lambda p: parts[replace(p, need="may")]
    uses = [(q, number(p), p.need, _idf2(posts, df.get(number(p), 0))) for q, ps in queries.items() for p in ps]
    asked = F.broadcast(spark.createDataFrame(uses, "query_id long, part int, need string, idf2 double"))
    musts = [(q, sum(p.need == "must" for p in ps)) for q, ps in queries.items()]
    wanted = F.broadcast(spark.createDataFrame(musts, "query_id long, musts int"))
    weight = F.sqrt(F.col("tf").cast("double")) * F.col("idf2") / F.sqrt(F.greatest("length", F.lit(1)).cast("double"))
    count: dict[str, Column] = {n: F.count_if(F.col("need") == n) for n in ("must", "may", "not")}
    met = rows.join(asked, "part").groupBy("query_id", "post").agg(
        F.round(F.sum(F.when(F.col("need") != "not", weight)), 6).alias("score"), *(c.alias(n) for n, c in count.items())
    )
    good = met.join(wanted, "query_id").filter((F.col("not") == 0) & F.when(F.col("musts") > 0, F.col("must") == F.col("musts")).otherwise(F.col("may") > 0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "post"))
    ranked = good.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("post").alias(key), "score", "rank")
