"""Mood classifiers on many sparse words, trained for all moods and grid points in one job a step.

Model. One logistic output for each mood and grid point (learning rate, exponent of time, L1), on word counts or presence and a
constant; or a network with one hidden layer of sigmoid units below the outputs. Weights of the words (``words`` rows, a
column a unit) are cut by rows into shards; a shard is a file in the shared folder with its sum of squared gradients.
Weights above a hidden layer are one more, small file. No weight passes through the driver.

Step. Posts, encoded once, are read in batches; a task maps the shards and gathers the rows of the words it meets, makes
products with a dense block of some posts at a time, and adds up gradients by word. Where a row for every word takes at
most ``HELD_BYTES``, all of it leaves the task once, by shard, at the end; else what it has gathered also leaves it when it
is over ``BUFFER`` bytes. A step has ``TASKS`` tasks a core at most, so what it shuffles doesn't grow with the posts. A
shard's reducer adds the parts, takes an ADAGrad step w -= rate * g / sqrt(sum of g * g) / t ** texp with the mean gradient
g (L1 added as l1 * sign(w)) and writes the shard's next file. So a step is one pass over its posts and one shuffle of gradients. ``batches`` cuts the posts by hash into as
many steps a pass.

A post without a label of the list is a negative case of every mood; posts without words train the constant. Null
words count as none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import vocabulary as V
from textloom.session import cut_lineage, shared_folder, stored
from textloom.sources import arrays

BUFFER = 32 << 20
#: Gradients of all words that a task may hold; of these it takes up what it meets.
HELD_BYTES = 160 << 20
TASKS = 2
SHARD_BYTES = 16 << 20
PART = "shard int, ids binary, sums binary"


class Point(NamedTuple):
    """A grid point: step size, how steps shrink with time, L1."""

    rate: float = 1.0
    texp: float = 0.0
    l1: float = 0.0


#: The grid of the original: 18 points.
GRID = tuple(Point(rate, texp, l1) for rate in (0.01, 0.1, 1.0) for texp in (0.25, 0.5) for l1 in (1e-8, 1e-7, 1e-6))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model(NamedTuple):
    folder: str
    step: int
    words: int  # rows of words; the constant is one more
    labels: tuple
    points: tuple[Point, ...]
    hidden: int
    binary: bool
    rows: int  # of a shard
    buffer: int  # bytes of weights or gradients that a task holds at once
    vocabulary: DataFrame

    @property
    def units(self) -> int:
        return self.hidden or self.outputs

    @property
    def outputs(self) -> int:
        return len(self.labels) * len(self.points)

    @property
    def shards(self) -> int:
        return -(-(self.words + 1) // self.rows)

    def plain(self) -> "Model":
        """Without the vocabulary, for tasks."""
        return self._replace(vocabulary=None)

    def name(self, shard: int) -> str:
        return f"w{self.step}-{shard}"

    def gather(self, ids: np.ndarray) -> np.ndarray:
        """The weights of words."""
        out = np.empty((len(ids), self.units))
        shard = ids // self.rows
        for k in np.unique(shard):
            own = np.flatnonzero(shard == k)
            out[own] = arrays.load(self.folder, self.name(int(k)))[ids[own] - k * self.rows]
        return out

    def top(self) -> np.ndarray:
        """Weights above the hidden layer, the constant's last."""
        return np.asarray(arrays.load(self.folder, self.name(self.shards)))

    def start(self, shard: int) -> np.ndarray:
        """First weights: zeros, or small random ones where there is a hidden layer."""
        n = self.hidden + 1 if shard == self.shards else min(self.rows, self.words + 1 - shard * self.rows)
        width = self.outputs if shard == self.shards else self.units
        if not self.hidden:
            return np.zeros((n, width))
        return np.random.default_rng((7, shard)).normal(0, 0.1 if shard < self.shards else 1 / np.sqrt(self.hidden), (n, width))


def _blocks(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Some posts at a time: their words' ids (the constant last), a dense matrix posts x words, and which posts."""
    ids, offsets = batch.column("ids").flatten().to_numpy(), batch.column("ids").offsets.to_numpy()
    counts = batch.column("counts").flatten().to_numpy()
    offsets = offsets - offsets[0]
    most = max(1, model.buffer // (8 * model.units))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, min(begin + 256, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1))
        own = slice(offsets[begin], offsets[stop])
        words, place = np.unique(ids[own], return_inverse=True)
        dense = np.zeros((stop - begin, len(words) + 1))
        dense[np.repeat(np.arange(stop - begin), np.diff(offsets[begin : stop + 1])), place] = 1.0 if model.binary else counts[own]
        dense[:, -1] = 1.0
        yield np.append(words, model.words), dense, np.arange(begin, stop), slice(begin, stop)
        begin = stop


def _forward(model: Model, ids: np.ndarray, dense: np.ndarray, top: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    z = dense @ model.gather(ids)
    if not model.hidden:
        return _sigmoid(z), None
    h = np.column_stack([_sigmoid(z), np.ones(len(z))])
    return _sigmoid(h @ top), h


def _encode(posts: DataFrame, vocabulary: DataFrame, words: str) -> DataFrame:
    """posts with ids (from 0) and counts of their known words in place of the words."""
    own = cut_lineage(vocabulary.select("word", "word_id"))
    if V.table_bytes(own) > V.BROADCAST_BYTES:
        raise ValueError("the vocabulary is over the bytes that may be broadcast: ask for fewer words")
    found = own.toArrow()
    names, numbers = found["word"].combine_chunks(), found["word_id"].to_numpy() - 1
    shared = posts.sparkSession.sparkContext.broadcast((names, numbers))
    rest = [f for f in posts.schema if f.name not in (words, "ids", "counts")]
    schema = T.StructType([*rest, *T.StructType.fromDDL("ids array<int>, counts array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = shared.value
        for batch in batches:
            column = batch.column(words)
            flat = column.flatten().dictionary_encode()
            at = pc.index_in(flat.dictionary, value_set=names.cast(flat.dictionary.type)).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.where(at >= 0, numbers[np.maximum(at, 0)] if len(numbers) else -1, -1)
            ids = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))[ids >= 0]
            most = len(numbers) + 1
            pairs, n = np.unique(owner * most + ids[ids >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(column) + 1) * most), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pairs % most, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *lists], names=schema.names)

    return posts.select(*(f.name for f in rest), words).mapInArrow(run, schema)


def _merge(ids: list[np.ndarray], rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    whole, place = np.unique(np.concatenate(ids), return_inverse=True)
    sums = np.zeros((len(whole), rows[0].shape[1]))
    np.add.at(sums, place, np.concatenate(rows))
    return [whole], [sums]


def _gradients(model: Model, top_shape: tuple[int, int]):
    """Sums over posts of the gradients, by shard."""
    targets = np.arange(len(model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = model.top() if model.hidden else None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        above = np.zeros(top_shape)
        whole = (model.words + 1) * model.units * 8 <= HELD_BYTES
        sums = np.zeros((model.words + 1 if whole else 0, model.units))
        met = np.zeros(len(sums), bool)
        for batch in batches:
            y = np.repeat(batch.column("target").fill_null(-1).to_numpy()[:, None] == targets, len(model.points), axis=1)
            for words, dense, _, which in _blocks(batch, model):
                p, h = _forward(model, words, dense, top)
                back = p - y[which]
                if model.hidden:
                    above += h.T @ back
                    back = (back @ top[:-1].T) * h[:, :-1] * (1 - h[:, :-1])
                if whole:
                    sums[words] += dense.T @ back  # a block has each word once
                    met[words] = True
                    continue
                ids.append(words)
                rows.append(dense.T @ back)
                if sum(r.nbytes for r in rows) > model.buffer:
                    ids, rows = _merge(ids, rows)
                    if rows[0].nbytes > model.buffer // 2:
                        yield from _parts(model, ids[0], rows[0])
                        ids, rows = [], []
        for first in range(0, len(sums), model.rows) if met.any() else ():
            if len(own := first + np.flatnonzero(met[first : first + model.rows])):
                yield _part(first // model.rows, own - first, sums[own])
        if ids:
            yield from _parts(model, *(x[0] for x in _merge(ids, rows)))
        if above.any():
            yield _part(model.shards, np.arange(len(above)), above)

    return run


def _parts(model: Model, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    shard = ids // model.rows
    for k in np.unique(shard):
        yield _part(int(k), ids[shard == k] - k * model.rows, rows[shard == k])


def _part(shard: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "sums"])


def _update(model: Model, posts: int):
    """Write a shard's next weights; gives the shard and the greatest entry of its mean gradient."""
    per = {name: np.array([getattr(p, name) for p in model.points]) for name in Point._fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total, old = None, None, None
        for batch in batches:
            for k, ids, sums in zip(batch.column("shard").to_pylist(), batch.column("ids"), batch.column("sums")):
                if shard is None:
                    shard, old = k, np.array(arrays.load(model.folder, model.name(k)))
                    total = np.zeros_like(old)
                where = np.frombuffer(ids.as_buffer(), np.int64)
                if len(where):
                    total[where] += np.frombuffer(sums.as_buffer()).reshape(len(where), -1)
        if shard is None:
            return
        # Columns are label by label, each with all points; below a hidden layer there is one point.
        rate, texp, l1 = (np.tile(per[n], old.shape[1] // len(model.points)) for n in Point._fields)
        loss = total / max(1, posts)
        g = loss + l1 * np.sign(old)
        squares = np.array(arrays.load(model.folder, f"g{model.step}-{shard}")) + g * g
        new = old - rate * g / np.sqrt(np.maximum(squares, 1e-20)) / (model.step + 1) ** texp
        after = model._replace(step=model.step + 1)
        arrays.save(model.folder, after.name(shard), new)
        arrays.save(model.folder, f"g{after.step}-{shard}", squares)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "gradient": pa.array([float(np.abs(loss).max(initial=0))])})

    return run


def train(
    posts: DataFrame, labels: Sequence, points: Sequence[Point] = (Point(),), n_words: int = 75_000, hidden: int = 0, passes: int = 10, batches: int = 1,
    binary: bool = False, label: str = "label", words: str = "words",
) -> Model:
    """Fit all labels and grid points together."""
    if hidden and len(points) > 1:
        raise ValueError("a network has one grid point")
    spark = posts.sparkSession
    vocabulary = cut_lineage(V.first_words(posts, n_words, words).select("word", "word_id"))
    shard = max(1, SHARD_BYTES // (8 * (hidden or len(labels) * len(points))))
    model = Model(shared_folder(spark, "learner"), 0, vocabulary.count(), tuple(labels), tuple(points), hidden, binary, shard, BUFFER, vocabulary)
    number = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col(label)) - 1
    slim = posts.select(F.coalesce(number, F.lit(-1)).cast("int").alias("target"), words, F.pmod(F.xxhash64(words), F.lit(batches)).cast("int").alias("batch"))
    ready = stored(_encode(slim, vocabulary, words), "encoded")
    sizes = {r["batch"]: r["n"] for r in ready.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
    count = model.shards + bool(hidden)
    base, top = model.plain(), (hidden + 1, model.outputs) if hidden else (0, 0)

    def begin(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for k in batch.column("id").to_pylist():
                first = base.start(k)
                arrays.save(base.folder, base.name(k), first)
                arrays.save(base.folder, f"g0-{k}", np.zeros_like(first))
            yield batch

    spark.range(count).mapInArrow(begin, "id long").count()
    # A row without gradients for each shard, so that every shard is written at each step.
    none = spark.range(count).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("ids"), F.lit(b"").alias("sums"))
    most = max(1, TASKS * spark.sparkContext.defaultParallelism)
    for _ in range(passes):
        for batch in sorted(sizes):
            now = model.plain()
            own = ready.filter(F.col("batch") == batch).select("target", "ids", "counts").coalesce(most)
            parts = own.mapInArrow(_gradients(now, top), PART)
            dealt = parts.unionByName(none).repartitionById(count, F.col("shard"))
            dealt.mapInArrow(_update(now, sizes[batch]), "shard int, gradient double").count()
            # The step before last goes; the last stays for tasks that run twice.
            arrays.forget(model.folder, (f"{kind}{model.step - 1}-{k}" for kind in "wg" for k in range(count)))
            model = model._replace(step=model.step + 1)
    return model


def probabilities(model: Model, posts: DataFrame, words: str = "words", out: str = "p") -> DataFrame:
    """posts with an array: label by label, each with all grid points."""
    named = posts.withColumn("_words", F.col(words))
    coded = _encode(named, model.vocabulary, "_words")
    rest = [f for f in posts.schema if f.name != out]
    schema = T.StructType([*rest, T.StructField(out, T.ArrayType(T.DoubleType()))])
    now = model.plain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = now.top() if now.hidden else None
        for batch in batches:
            p = np.zeros((batch.num_rows, now.outputs))
            for ids, dense, _, which in _blocks(batch, now):
                p[which] = _forward(now, ids, dense, top)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * now.outputs, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), lists], names=schema.names)

    return coded.mapInArrow(run, schema)


def predict(model: Model, posts: DataFrame, point: int = 0, words: str = "words") -> DataFrame:
    """posts with p_<label> for each label, at a grid point, and the most likely label."""
    scored = probabilities(model, posts, words, "_p")
    n = len(model.points)
    named = scored.withColumns({f"p_{x}": F.get("_p", F.lit(k * n + point)) for k, x in enumerate(model.labels)})
    best = F.array_max(F.array(*(F.struct(F.col(f"p_{x}").alias("p"), F.lit(x).alias("x")) for x in model.labels)))
    return named.withColumn("predicted", best["x"]).drop("_p")


def grid_scores(model: Model, posts: DataFrame, label: str = "label", words: str = "words") -> DataFrame:
    """(label, point, rate, texp, l1, auc, loglik) of every label and grid point over held-out posts."""
    from textloom.operators import metrics

    places = [(k * len(model.points) + j, x, j, *p) for k, x in enumerate(model.labels) for j, p in enumerate(model.points)]
    kind = posts.schema[label].dataType.simpleString()
    names = F.broadcast(posts.sparkSession.createDataFrame(places, f"at int, target {kind}, point int, rate double, texp double, l1 double"))
    flat = probabilities(model, posts.select(F.col(label).alias("_y"), words), words).select("_y", F.posexplode("p").alias("at", "score"))
    rows = cut_lineage(flat.join(names, "at").withColumn("label", F.coalesce(F.col("_y") == F.col("target"), F.lit(False)).cast("long")))
    agree = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    fit = rows.groupBy("at").agg(F.round(F.avg(F.log(agree + 1e-7)), 6).alias("loglik"))
    areas = metrics.auc(rows.select("at", "score", "label"), ["at"]).select("at", "auc")
    return names.join(fit, "at").join(areas, "at").select(F.col("target").alias("label"), "point", "rate", "texp", "l1", "auc", "loglik")
