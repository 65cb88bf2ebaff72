"""Semantic queries: the sentences nearest to weighted query sentences.

A query is one text or several (summed into one vector). ``[w]`` after a word weighs that word; a weight without a
word before it is ignored, other words weigh 1, weights may be negative.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators.embedding import sentence_scores, sentence_vectors
from textloom.session import cut_lineage

#: Scores are equal when they agree to this many decimals.
DIGITS = 6
#: Queries are scored in blocks of so many.
BLOCK = 256
#: With rejected rows that hide their equals, so many scores are looked at first for each row asked for, and a task holds so many rows at most.
DEPTH, HELD_ROWS = 500, 1 << 16

Query = str | Sequence[str]


def parse_query(text: str) -> list[tuple[str, float]]:
    """(word, weight) in order; words are lower-cased and parted at spaces."""
    found: list[list] = []
    last = None
    for piece in text.lower().split():
        if mark := re.fullmatch(r"\[\s*(-?[0-9]*\.?[0-9]+)\s*\]", piece):
            if last is not None:
                found[last][1] = float(mark[1])
            last = None
        else:
            found.append([piece, 1.0])
            last = len(found) - 1
    return [(w, x) for w, x in found]


def query_terms(spark: SparkSession, queries: Sequence[Query]) -> DataFrame:
    """(query_id, word, weight), weights of repeated words added up."""
    rows: dict[tuple[int, str], float] = {}
    for k, query in enumerate(queries):
        for text in [query] if isinstance(query, str) else query:
            for word, weight in parse_query(text):
                rows[k, word] = rows.get((k, word), 0.0) + weight
    return spark.createDataFrame([(k, w, x) for (k, w), x in rows.items()], "query_id long, word string, weight double")


def unknown_terms(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    """The terms without a word vector."""
    return terms.join(vectors.select("word"), "word", "left_anti").select("query_id", "word")


def query_vectors(terms: DataFrame, vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors by query. Queries without a known word, or that sum to zero, have none; a warning names them.

    The vectors are met in Spark; what comes to the driver is a row for each term of the stated queries.
    """
    asked = {r[0] for r in terms.select("query_id").distinct().toLocalIterator()}
    met = vectors.join(F.broadcast(terms), "word").select("query_id", "weight", F.col("vector").cast("array<double>").alias("vector"))
    sums: dict[int, np.ndarray] = {}
    for row in sorted(met.collect(), key=lambda r: (r["query_id"], r["weight"], r["vector"])):
        sums[row["query_id"]] = sums.get(row["query_id"], 0.0) + row["weight"] * np.array(row["vector"])
    units = {k: v / np.sqrt(v @ v) for k, v in sums.items() if v @ v > 0}
    if lost := sorted(asked - set(units)):
        warnings.warn(f"queries without a vector: {lost}", stacklevel=2)
    return dict(sorted(units.items()))


def score(sentences: DataFrame, units: dict[int, np.ndarray], method: str = "batch") -> DataFrame:
    """A row (…, query_id, score) for each sentence with a vector and each query, vector left out.

    method is batch (numpy products of Arrow batches) or columns (one compiled expression a query); both agree.
    """
    rest = [c for c in sentences.columns if c != "vector"]
    known = sentences.filter(F.col("vector").isNotNull())
    if not units:
        return known.select(*rest, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("score")).limit(0)
    ids = list(units)
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    parts = [_columns(known, rest, units, b) if method == "columns" else _batch(known, rest, units, b) for b in blocks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_words(sentences: DataFrame, vectors: DataFrame, units: dict[int, np.ndarray], most: int | None = None) -> DataFrame:
    """As score, of sentences without their vectors: sums and products are made in one pass over the words.

    most: of a query only rows whose score can be among the so many best rounded ones of their task.
    """
    ids = list(units)
    if not ids:
        return score(sentences.withColumn("vector", F.lit(None).cast("array<double>")), units)
    out = []
    for block in (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)):
        # A sentence without a vector has null scores, of which inline makes no row.
        scored = sentence_scores(sentences, vectors, np.stack([units[k] for k in block]).T, stays=None if most is None else partial(Levels, most))
        pairs = F.arrays_zip(F.array(*(F.lit(k).cast("long") for k in block)).alias("query_id"), F.col("scores").alias("score"))
        flat = scored.select(*sentences.columns, F.inline(pairs))
        out.append(flat if most is None else flat.filter(F.col("score").isNotNull()))
    return reduce(DataFrame.unionByName, out)


def _columns(known: DataFrame, rest: list[str], units: dict[int, np.ndarray], ids: list[int]) -> DataFrame:
    scores = F.array(*(F.struct(F.lit(k).cast("long").alias("query_id"), V.dot_with(F.col("vector"), units[k]).alias("score")) for k in ids))
    return known.select(*rest, F.inline(scores))


def _batch(known: DataFrame, rest: list[str], units: dict[int, np.ndarray], ids: list[int]) -> DataFrame:
    table = np.stack([units[k] for k in ids]).T

    @F.pandas_udf("array<double>")
    def products(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.stack(batch.to_numpy()) @ table) if len(batch) else [], dtype=object)

    scored = known.select(*rest, products(F.col("vector")).alias("_s"))
    pairs = F.arrays_zip(F.array(*(F.lit(k).cast("long") for k in ids)).alias("query_id"), F.col("_s").alias("score"))
    return scored.select(*rest, F.inline(pairs))


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows (key, vector) as blocks of at most size unit vectors: keys array, units binary. Zero and null vectors go."""
    fields = f"keys array<{rows.schema[key].dataType.simpleString()}>, units binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, size) for k in range(0, batch.num_rows, size)):
                table = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                n = np.sqrt(np.einsum("ij,ij->i", table, table))
                keys = part.column(key).filter(pa.array(n > 0))
                if len(keys):
                    lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                    units = pa.array([(table[n > 0] / n[n > 0, None]).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([lists, units], names=["keys", "units"])

    return rows.filter(F.col("vector").isNotNull()).select(key, "vector").mapInArrow(pack, fields)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str, block: int = 1024) -> DataFrame:
    """(query_id, key, score, rank): the k rows of greatest cosine for each query vector; equal rounded scores go by key.

    Both sides are packed into blocks; each pair of blocks is one product, of which k rows a query leave the task. Blocks
    of queries meet blocks of rows in Spark, so neither passes through the driver.
    """
    a, b = _packed(queries, key, block), _packed(rows, key, block)
    pairs = b.crossJoin(a.select(F.col("keys").alias("asked"), F.col("units").alias("wanted")))
    kind = rows.schema[key].dataType.simpleString()

    def score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, asked = (batch.column(c)[i].values for c in ("keys", "asked"))
                own, wanted = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(len(x), -1) for c, x in (("units", keys), ("wanted", asked)))
                scores = np.round(wanted @ own.T, DIGITS)
                most = min(k, len(keys))
                # All that reach the k-th score: which of equals stay is told by key, later.
                least = np.partition(scores, len(keys) - most, axis=1)[:, len(keys) - most]
                q, r = np.nonzero(scores >= least[:, None])
                arrays = [asked.take(pa.array(q)), keys.take(pa.array(r)), pa.array(scores[q, r])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", key, "score"])

    found = pairs.mapInArrow(score_blocks, f"query_id {kind}, {key} {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def exclusion(words: str, exclude: str | None, how: str = "substring") -> Column:
    """Whether a sentence stays: exclude is a substring, a regex, or words parted by spaces (how = words)."""
    if exclude is None:
        return F.lit(True)
    text = F.array_join(words, " ")
    if how == "substring":
        return ~F.contains(text, F.lit(exclude))
    if how == "regex":
        return ~text.rlike(exclude)
    if how == "words":
        return ~F.arrays_overlap(words, F.array(*(F.lit(w) for w in exclude.split())))
    raise ValueError(f"how is substring, regex or words, not {how!r}")


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as Spark's round gives them: halves of the shortest decimal go away from zero."""
    x = scores * 10.0**DIGITS
    known = np.isfinite(x)
    whole = np.rint(x)
    out = np.where(known, whole / 10.0**DIGITS + 0.0, scores)
    x, whole = np.where(known, x, 0.0), np.where(known, whole, 0.0)
    for i in np.flatnonzero((np.abs(np.abs(x - whole) - 0.5) < 1e-5) | (np.abs(x) > 1e8)):
        exact = Decimal(repr(float(scores[i])))
        out[i] = float(exact.quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) + 0.0 if exact.adjusted() < 20 else scores[i]
    return out


def levels(scores: np.ndarray) -> np.ndarray:
    """Rounded scores as numbers that are ordered as Spark orders scores: what is no number comes after all others."""
    return np.where(np.isnan(scores), np.inf, np.clip(rounded(scores.ravel()).reshape(scores.shape), -1e308, 1e308))


class Levels:
    """Which scores can be among a task's k best rounded ones of a query, as far as the task has come.

    Called with a row a sentence and a column a query. A score that is left out stands below k others that were met; equals of
    one that stays all stay.
    """

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, np.ndarray] = {}

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        level, stays = levels(scores), np.ones(scores.shape, bool)
        for j in range(scores.shape[1]):
            known = self.best.get(j, np.empty(0))
            found = np.unique(np.concatenate([known, level[:, j] if len(known) < self.k else level[level[:, j] > known[0], j]]))[-self.k :]
            self.best[j] = found
            if len(found) == self.k:
                stays[:, j] = level[:, j] >= found[0]
        return stays


def _ordered(value) -> tuple:
    """A value as something that Python orders as Spark does, nulls first."""
    if value is None:
        return ()
    if isinstance(value, float):
        return (value != value, value)
    if isinstance(value, dict):
        value = list(value.values())
    return (tuple(map(_ordered, value)),) if isinstance(value, (list, tuple)) else (value,)


class _Best:
    """A task's best rows of one query: of each rounded score the first by keys, then the other columns; k scores at most."""

    def __init__(self, k: int, keys: Sequence[str], rest: Sequence[str]):
        self.k, self.keys, self.rest = k, keys, rest
        self.rows: dict[float, tuple[tuple, tuple, float | None]] = {}
        self.least = -np.inf

    def meet(self, batch: pa.RecordBatch, which: np.ndarray, scores: pa.Array) -> None:
        """Rows of a batch (which, by place) with their scores; null ones come last, those that are no number first."""
        plain = scores.to_numpy(zero_copy_only=False).astype(np.float64)
        level = np.where(np.asarray(scores.is_null()), -np.inf, levels(plain))
        at = np.flatnonzero(level >= self.least)
        if len(at) > self.k and len(found := np.unique(level[at])) > self.k:
            at = at[level[at] >= found[-self.k]]
        if not len(at):
            return
        known = list(zip(*(batch.column(c).take(pa.array(which[at])).to_pylist() for c in self.keys)))
        for i, key in zip(at, known, strict=True):
            mark, old = tuple(map(_ordered, key)), self.rows.get(x := float(level[i]))
            if old is not None and old[0] < mark:
                continue
            row = (*key, *(batch.column(c)[int(which[i])].as_py() for c in self.rest))
            if old is None or mark < old[0] or tuple(map(_ordered, row)) < tuple(map(_ordered, old[1])):
                self.rows[x] = (mark, row, scores[int(i)].as_py())
        if len(self.rows) >= self.k:
            stays = sorted(self.rows, reverse=True)[: self.k]
            self.rows, self.least = {x: self.rows[x] for x in stays}, stays[-1]


def _batches(best: dict, schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of each query's _Best as batches of the schema."""
    for query, own in best.items():
        held = list(own.rows.values())
        for part in (held[k : k + size] for k in range(0, len(held), size)):
            columns = dict(zip((*own.keys, *own.rest), zip(*(row for _, row, _ in part)))) | {"query_id": [query] * len(part), "score": [x for _, _, x in part]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def own_best(scored: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """What can be among the k best scores of a query: of each score the first row by keys in its task, k scores a task.

    Rows are met as they come and few stay, so a task neither sorts nor shuffles what it reads.
    """
    schema = scored.schema
    rest = [c for c in scored.columns if c not in (*keys, "query_id", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        kinds = None
        for batch in batches:
            kinds, ids = batch.schema, batch.column("query_id").dictionary_encode(null_encoding="encode")
            for q, query in enumerate(ids.dictionary.to_pylist()):
                which = np.flatnonzero(ids.indices.to_numpy(zero_copy_only=False) == q)
                own = best.setdefault(query, _Best(k, keys, rest))
                own.meet(batch, which, batch.column("score").take(pa.array(which)))
        if kinds is not None:
            yield from _batches(best, kinds)

    return scored.mapInArrow(run, schema)


def _firsts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of a query with one rounded score, the first by keys, then the other columns."""
    rest = [c for c in rows.columns if c not in (*keys, "query_id", "score")]
    first = F.min(F.struct(*keys, *rest)).alias("first")
    return rows.withColumn("score", F.round("score", DIGITS)).groupBy("query_id", "score").agg(first).select("query_id", "score", "first.*")


def _ranked(rows: DataFrame, k: int, keys: Sequence[str], offset: int = 0) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *keys))
    ranked = rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k + offset)
    return ranked.filter(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)


def _top(best: Callable[[int | None], DataFrame], k: int, keys: Sequence[str], dedupe: str, offset: int = 0) -> DataFrame:
    """top_scores of rows that best gives: those of each task's m best scores, or (for None) all.

    With pre a score of a row that fails (_ok) is lost, so more scores are looked at until enough rows pass or none are
    left. Beyond HELD_ROWS scores a task, all rows are shuffled.
    """
    if dedupe == "post":
        return _ranked(_firsts(best(k + offset), keys), k, keys, offset)
    most = DEPTH * (k + offset)
    while most <= HELD_ROWS:
        rows = cut_lineage(_ranked(_firsts(best(most), keys), most, keys).drop("rank"))
        passing = rows.groupBy("query_id").agg(F.count_if("_ok").alias("good"), F.count("*").alias("n"))
        if passing.filter((F.col("good") < k + offset) & (F.col("n") == most)).isEmpty():
            break
        most *= 8
    else:
        rows = _firsts(best(None), keys)
    return _ranked(rows.filter("_ok").drop("_ok"), k, keys, offset)


def top_scores(scored: DataFrame, k: int, keys: Sequence[str], min_words: int = 0, keep: Column | None = None, dedupe: str | None = "post", offset: int = 0) -> DataFrame:
    """Each query's k best rows by rounded score, then keys, as (…, rank) after leaving out the first offset rows.

    dedupe
        post  rows that pass the tests count once for a score
        pre   a score counts once, for its first row by keys; if that row fails the tests, its equals are gone too
        None  equal scores stay
    With post and pre each task keeps only its own best scores, so few rows are shuffled, however long they are.
    """
    passes = (F.col("n_words") >= min_words) & (F.lit(True) if keep is None else keep)
    rows = scored.withColumn("score", F.round("score", DIGITS))
    if dedupe is None:
        return _ranked(rows.filter(passes), k, keys, offset)
    rows = rows.withColumn("_ok", passes) if dedupe == "pre" else rows.filter(passes)
    return _top(lambda most: rows if most is None else own_best(rows, most, keys), k, keys, dedupe, offset)


def search(
    sentences: DataFrame, vectors: DataFrame, queries: Sequence[Query], k: int = 20, keys: Sequence[str] = ("post_id", "sent"),
    min_words: int = 15, exclude: str | None = None, how: str = "substring", dedupe: str | None = "post", method: str = "batch",
) -> DataFrame:
    """The k nearest sentences of each query. sentences has keys, words, n_words and, unless it is to be made, vector."""
    units = query_vectors(query_terms(sentences.sparkSession, queries), vectors)
    if dedupe != "pre":
        # Before any vector is made; top_scores tests them once more, at no cost to speak of.
        sentences = sentences.filter((F.col("n_words") >= min_words) & exclusion("words", exclude, how))
    if "vector" not in sentences.columns and method == "batch" and dedupe is not None and units:
        rows = sentences if dedupe == "post" else sentences.withColumn("_ok", (F.col("n_words") >= min_words) & exclusion("words", exclude, how))
        return _top(lambda most: score_words(rows, vectors, units, most), k, keys, dedupe)
    if "vector" not in sentences.columns and method == "batch":
        scored = score_words(sentences, vectors, units)
    else:
        made = sentences if "vector" in sentences.columns else sentence_vectors(sentences, vectors)
        scored = score(made, units, method)
    return top_scores(scored, k, keys, min_words, exclusion("words", exclude, how), dedupe)


def plain_search(sentences: DataFrame, vectors: DataFrame, text: str, k: int = 20, keys: Sequence[str] = ("post_id", "sent")) -> DataFrame:
    """One query without weights, filters or a least length."""
    return search(sentences, vectors, [re.sub(r"\[[^\]]*\]", " ", text)], k, keys, min_words=0)


def multi_query(
    sentences: DataFrame, vectors: DataFrame, queries: Sequence[Query], k: int = 20, keys: Sequence[str] = ("post_id", "sent"), ignore: int = 0, dedupe: str | None = "post"
) -> DataFrame:
    """Sentences by the sum of their scores for all queries; a sentence without a vector scores 0. Equal scores count
    once, and the first `ignore` of those that count go. sentences has words, or their vector.

    The scores of one sentence are added up in its row: the sum of products is the product with the queries' sum.
    """
    units = query_vectors(query_terms(sentences.sparkSession, queries), vectors)
    rest = [c for c in sentences.columns if c != "vector"]
    total = F.lit(0.0)
    if units:
        whole = np.sum(list(units.values()), axis=0)
        if "vector" in sentences.columns:
            total = V.dot_with(F.col("vector"), whole)
        elif dedupe == "post":

            def best(most: int) -> DataFrame:
                scored = sentence_scores(sentences, vectors, whole[:, None], missing=0.0, stays=partial(Levels, most))
                return scored.filter(F.col("scores").isNotNull()).select(*rest, F.lit(0).cast("long").alias("query_id"), F.get("scores", F.lit(0)).alias("score"))

            return _top(best, k, keys, dedupe, ignore).drop("query_id")
        else:
            sentences = sentence_scores(sentences, vectors, whole[:, None])
            total = F.get("scores", F.lit(0))
    scored = sentences.select(*rest, F.lit(0).cast("long").alias("query_id"), F.coalesce(total, F.lit(0.0)).alias("score"))
    return top_scores(scored, k, keys, dedupe=dedupe, offset=ignore).drop("query_id")


def merge_results(results: DataFrame, k: int = 1000, keys: Sequence[str] = ("post_id", "sent")) -> DataFrame:
    """Results of several runs or parts as one: equal scores of a query count once, k rows each."""
    return top_scores(results.drop("rank"), k, keys)


def save_results(results: DataFrame, path: str) -> None:
    results.write.partitionBy("query_id").mode("overwrite").parquet(path)
