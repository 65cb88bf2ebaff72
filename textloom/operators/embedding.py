"""Word vectors aligned with a vocabulary, and sentence vectors made from them.

Vectors are tables (word, vector array<double>). A sentence vector is the sum of its words' vectors, repeats
counted, divided by its length; a sentence whose sum is zero has a null vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.functions.columns import sample_share
from textloom.operators.vocabulary import join_words
from textloom.session import stored
from textloom.sources.vector_store import VectorStore, store_vectors

#: A matrix of word vectors up to this size is broadcast; larger ones are stored in files that tasks map.
BROADCAST_BYTES = 256 << 20


def train_word2vec(
    posts: DataFrame, dim: int = 300, window: int = 10, least: int = 5, words: str = "words", partitions: int | None = None, passes: int = 1, seed: int = 42
) -> Word2VecModel:
    """Skip-gram vectors of posts or sentences. Each of the partitions (by default as many as posts has) trains on its
    own posts and their vectors are combined after a pass; more passes make up for many partitions."""
    rows = posts.filter(F.size(words) > 0).select(words)
    learner = Word2Vec(
        vectorSize=dim, windowSize=window, minCount=least, inputCol=words, outputCol="vector",
        numPartitions=partitions or max(1, rows.rdd.getNumPartitions()), seed=seed, maxIter=passes,
    )
    return learner.fit(rows)


def model_vectors(model: Word2VecModel) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def align(vocabulary: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Every word of the vocabulary with its vector, zeros for words without one."""
    known = vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    joined = vocabulary.join(known, "word", "left")
    return joined.withColumn("vector", F.coalesce("vector", V.zeros(dim)))


def without_stop_words(vectors: DataFrame, stop_words: list[str]) -> DataFrame:
    """Stop words add nothing to a sentence: their vectors go."""
    return vectors.filter(~F.col("word").isin(stop_words)) if stop_words else vectors


def unit_words(vectors: DataFrame) -> DataFrame:
    """Each word vector divided by its length; zero vectors go."""
    return vectors.withColumn("_n", V.norm(F.col("vector"))).filter("_n > 0").withColumn("vector", V.scaled(F.col("vector"), 1 / F.col("_n"))).drop("_n")


def matrix(vectors: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> tuple[list[str], np.ndarray] | None:
    """Words and their vectors in the driver, or None if they are over limit_bytes; the size is found first."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not size["n"] or size["n"] * (8 * size["dim"] + 100) > limit_bytes:
        return None if size["n"] else ([], np.zeros((0, 1)))
    found = vectors.select("word", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    flat = found["vector"].combine_chunks().values.to_numpy(zero_copy_only=False)
    return found["word"].to_pylist(), flat.reshape(found.num_rows, -1)


#: What a task finds vectors with: a matrix with its words, or a store of mapped files.
Source = tuple[list[str], np.ndarray] | VectorStore


def source(vectors: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> Source:
    """The matrix if it is within limit_bytes, else a store in the shared folder."""
    held = matrix(vectors, limit_bytes)
    return store_vectors(vectors) if held is None else held


def sentence_vectors(
    rows: DataFrame, vectors: DataFrame | VectorStore, words: str = "words", method: str = "auto", limit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """rows with a column vector: the unit sum of their words' vectors, null where it is zero or no word is known.

    method
        batch  the matrix is broadcast and each Arrow batch of sentences is summed by numpy: nothing is shuffled
        store  the same with vectors in mapped files: neither a shuffle of sentences nor a broadcast of vectors
        join   whole rows are dealt by number; then words are exploded, joined and summed by dimension inside each task
        auto   batch if the matrix is within limit_bytes, else store
    """
    if method == "join":
        return _joined(rows, vectors, words)
    if method == "store" and not isinstance(vectors, VectorStore):
        vectors = store_vectors(vectors)
    held: Source | None = vectors if isinstance(vectors, VectorStore) else source(vectors, limit_bytes) if method == "auto" else matrix(vectors, limit_bytes)
    if held is None:
        raise ValueError(f"the vectors are over {limit_bytes} bytes")
    return rows.withColumn("vector", _per_sentence(held, lambda units: units, F.col(words), rows))


def _sums(sentences: pa.Array, find: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of a batch that have known words, and the sums of their vectors; a distinct word is looked up once."""
    flat = sentences.flatten().dictionary_encode()
    known, table = find(flat.dictionary.to_pylist())
    ids = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    lengths = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sentences)), lengths)[ids >= 0]
    ids = ids[ids >= 0]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    out = np.empty((len(first), table.shape[1]))
    # Word vectors are gathered for some sentences at a time; a sentence's own words bound what that takes.
    for k in range(0, len(first), 512):
        begin, stop = first[k], first[k + 512] if k + 512 < len(first) else len(ids)
        out[k : k + 512] = np.add.reduceat(table[ids[begin:stop]], first[k : k + 512] - begin, axis=0)
    return owner[first], out


def _finder(held: Source) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    if isinstance(held, VectorStore):
        return held.find
    known, table = held
    place = {w: i for i, w in enumerate(known)}
    return lambda words: (np.fromiter((place.get(w, -1) for w in words), np.int64, len(words)), table)


def _pass(
    shared: VectorStore | Broadcast, result: Callable[[np.ndarray], np.ndarray], missing: float | None = None, stays: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None
) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A task's pass over the words of its sentences, for _per_sentence."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _finder(shared if isinstance(shared, VectorStore) else shared.value)
        kept = stays() if stays is not None else None
        for batch in batches:
            owner, sums = _sums(batch, find)
            n = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            found = result(sums[n > 0] / n[n > 0, None])
            has = np.zeros(len(batch), bool)
            has[owner[n > 0]] = True
            if missing is not None:
                every = np.full((len(batch), found.shape[1]), missing)
                every[has] = found
                found, has = every, np.ones(len(batch), bool)
            gone = None
            if kept is not None:
                good = kept(found)
                some = good.any(axis=1)
                has[has] = some
                found, gone = found[some], ~good[some].ravel()
            width = found.shape[1] if found.ndim == 2 else 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(has) * width]).astype(np.int32))
            values = pa.array(np.ascontiguousarray(found).ravel(), mask=gone)
            yield pa.ListArray.from_arrays(offsets, values, mask=pa.array(~has))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def _per_sentence(held: Source, result: Callable[[np.ndarray], np.ndarray], words: Column, rows: DataFrame, missing: float | None = None, stays: Callable | None = None) -> Column:
    """array<double> of each sentence: result of the unit sums; null where there is none (or made of ``missing``).

    stays makes, for a task, what tells which entries of each batch's results stay; others are null, and so are the arrays
    of sentences without any.

    The function counts as not deterministic, so that a filter on what it gives isn't moved below it, which would run
    it twice. Filters on other columns belong before it.
    """
    shared = held if isinstance(held, VectorStore) else rows.sparkSession.sparkContext.broadcast(held)
    return F.arrow_udf(_pass(shared, result, missing, stays), "array<double>").asNondeterministic()(words)


def sentence_scores(
    rows: DataFrame, vectors: DataFrame | VectorStore, units: np.ndarray, words: str = "words", limit_bytes: int = BROADCAST_BYTES,
    missing: float | None = None, stays: Callable | None = None,
) -> DataFrame:
    """rows with a column scores: the products of a sentence's vector with the columns of units, null without a vector.

    Sums and products are made in one pass and no vector leaves it. missing, stays: see _per_sentence.
    """
    held = vectors if isinstance(vectors, VectorStore) else source(vectors, limit_bytes)
    return rows.withColumn("scores", _per_sentence(held, lambda x: x @ units, F.col(words), rows, missing, stays))


def _joined(rows: DataFrame, vectors: DataFrame, words: str) -> DataFrame:
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    # Written once: the row numbers are met again in the last join, and must be the same there.
    marked = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "marked")
    # Dealt by row while rows are whole: a row's words, their sum and the row itself then stand in one task, and neither
    # words nor sums are shuffled (unless the vectors are too many to broadcast).
    dealt = marked.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_row")
    parts = join_words(dealt.select("_row", F.explode(words).alias("word")), vectors.select("word", "vector"))
    sums = parts.groupBy("_row").agg(*(F.sum(F.get("vector", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)))
    raw = sums.select("_row", F.array(*(f"d{i}" for i in range(dim))).alias("raw"))
    unit = raw.withColumn("n", V.norm(F.col("raw"))).select("_row", F.when(F.col("n") > 0, V.scaled(F.col("raw"), 1 / F.col("n"))).alias("vector"))
    return dealt.join(unit, "_row", "left").drop("_row")


def load_sample(rows: DataFrame, share: float, key: str | Column = "post_id", seed: int = 94720, most: int | None = None) -> DataFrame:
    """A reproducible share of the posts, kept in memory or on local disk for queries; most bounds the rows."""
    picked = rows.filter(sample_share(key, share, seed))
    return (picked if most is None else picked.limit(most)).persist()
