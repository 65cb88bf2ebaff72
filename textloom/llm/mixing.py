"""Mixing sources to target weights by entropy balancing.

Targets. Sources share ``share`` times all words by weight; a target stops at ``cap`` times its source's words
and the excess is reshared by weight among the others until none is above. In the order of size by weight the
sources that stop come first, so the level of the others follows from running sums over that order.

Rates. Among all document rates from 0 to ``cap`` that meet the sources' token totals, entropy balancing takes
those nearest to one copy each in relative entropy, sum(r log r - r + 1) over documents. They are exponential
tilts, r = min(cap, exp(lambda * size / scale)) with the source's mean size for its scale, and lambda solves the
convex dual, whose gradient is sum(size * r) - target. Newton's steps are taken on log(sum(size * r) / target),
which is nearly straight in lambda. Every step is one distributed sum of size * r and its derivative over all
documents (counted by source and size first, which both sums need only), for all sources at once; a step that
leaves the bracket known so far is replaced by its middle. A source is solved once its sum is within 1e-9 of the
target. lambda is rounded to nine digits and rates to 2 ** -20, so
that sums in another order give the same copies. A target of cap times its source's words takes every document cap
times. As documents count alike, however long, a source that is thinned loses long documents first, and one that
is repeated repeats long documents first.

Copies. A document is taken floor(rate) times, and once more if it lies below its source's threshold in the
order of u / (u + rest), where u in (0, 1] is a random number from md5(doc_id) and rest the rate's fraction
(sequential Poisson sampling: chances are near the fractions, the total is near the target). The threshold is
where the words still missing are reached most nearly. It is found by sums over 4,096 slices of that order, again
over 4,096 slices of the slice that holds it, and by a running sum over the documents of that last slice only, equal
ones counted; no source is gathered by one task. Documents that are equal in place, id and size and are cut by the
threshold are numbered in range partitions, by what else they hold, and as many as are wanted come once more.

Null or word-free texts have size 0 and their copies take no words. A null source is a source, last in order. Repeated
and null document ids are ordered by size too; totals come as near to their targets as with distinct ids, and reruns
agree. Extra columns named in ``keep`` come along. An empty table gives no rows. A source whose dual isn't solved
after ``NEWTON_STEPS`` steps is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, text_or_empty

#: Source tables of at most so many rows are broadcast; beyond that, joins on source are salted.
BROADCAST_SOURCES = 10_000
SALTS = 64
NEWTON_STEPS = 100


def word_count(text: str) -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(text), SPACES), "")).cast("long")


def join_sources(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Left join on source, nulls equal; a hot source doesn't meet in one task either way."""
    right = sources.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2"))
    return left.join(right, same, "left").drop("_source", "_salt", "_salt2")


def running_sums(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with running sums (without the row itself) of columns in an order, over range partitions: no task holds all rows."""
    keyed = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    joined = keyed.join(F.broadcast(offsets), "_part")
    found = {n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}
    return joined.withColumns(found).drop("_part", *(f"_{n}" for n in sums))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """sources with ``weight``: the weights in turn, over sources by code point, null last."""
    ranked = running_sums(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    return ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))).drop("rank")


def set_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with ``target``, in a fixed number of jobs."""
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by_need = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    run = running_sums(sources, by_need, full=F.col("source_size"), used=F.col("weight"))
    level = (share * F.lit(total["size"]) - cap * F.col("full")) / (F.lit(total["weight"]) - F.col("used"))
    # The first source that doesn't stop sets the level of all after it.
    fits = run.withColumn("level", level).filter(F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    first = fits.agg(F.min(F.struct(by_need[0].alias("need"), F.col("source").isNull().alias("none"), "source", "level")).alias("f")).first()["f"]
    most = cap * F.col("source_size")
    target = F.least(most, first["level"] * F.col("weight")) if first else most
    return sources.withColumn("target", target.cast("double"))


def tilt(size: Column, cap: float) -> Column:
    """A document's rate, from lam and scale."""
    return F.least(F.lit(cap), F.exp(F.least(F.col("lam") * size / F.col("scale"), F.lit(100.0))))


def balance(docs: DataFrame, sources: DataFrame, n_sources: int, cap: float = 2.0) -> DataFrame:
    """sources with ``lam`` and ``scale``, the solution of the dual: docs (source, size) are summed once a step."""
    sizes = cut_lineage(docs.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    means = sizes.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    start = join_sources(sources.withColumn("doc_id", F.lit(0)), means, n_sources).drop("doc_id")
    start = start.withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    at_cap, none = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.col("target") <= 0
    far = F.lit(float("inf"))
    state = cut_lineage(
        start.withColumns({"lam": F.lit(0.0), "lo": -far, "hi": far, "done": at_cap | none | (F.col("source_size") == 0), "at_cap": at_cap})
    )
    for _ in range(NEWTON_STEPS):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        rate = tilt(F.col("size"), cap)
        slope = F.when(rate < cap, rate * F.col("size") / F.col("scale")).otherwise(0.0)
        mass = F.col("n") * F.col("size")
        met = join_sources(sizes.withColumn("doc_id", F.col("size")), open_.select("source", "lam", "scale"), n_sources).filter("lam IS NOT NULL")
        sums = met.groupBy("source").agg(F.sum(mass * rate).alias("taken"), F.sum(mass * slope).alias("slope"))
        met = join_sources(state.withColumn("doc_id", F.lit(0)), sums, n_sources).drop("doc_id")
        gap = F.log(F.col("taken") / F.col("target"))
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        met = met.withColumns({"gap": gap, "lo2": lo, "hi2": hi}).withColumn("next", F.col("lam") - F.col("gap") * F.col("taken") / F.col("slope"))
        middle = F.when(F.col("hi2") == far, 2 * F.col("lo2") + 1).when(F.col("lo2") == -far, 2 * F.col("hi2") - 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        inside = (F.col("slope") > 0) & (F.col("next") > F.col("lo2")) & (F.col("next") < F.col("hi2"))
        solved = F.col("done") | (F.abs("gap") <= 1e-9) | (F.col("hi2") - F.col("lo2") <= 1e-13)
        state = cut_lineage(
            met.select(
                *sources.columns, "scale", F.when(solved, F.col("lam")).when(inside, F.col("next")).otherwise(middle).alias("lam"),
                F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), solved.alias("done"), "at_cap",
            )
        )
    else:
        if not state.filter(~F.col("done")).isEmpty():
            raise ValueError(f"a source's rates don't meet its target after {NEWTON_STEPS} steps")
    return state.select(*sources.columns, "scale", F.when(F.col("target") <= 0, -far).when(F.col("at_cap"), far).otherwise(F.round("lam", 9)).alias("lam"))


def with_rates(docs: DataFrame, sources: DataFrame, n_sources: int, cap: float = 2.0) -> DataFrame:
    """docs (doc_id, source, size, u) with ``rate`` in steps of 2 ** -20 and ``place``, twelve hex digits that order
    the documents of a source for their last copy."""
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("lam") == float("inf"), cap).when(F.col("lam") == -float("inf"), 0.0)
    rate = F.when(F.col("size") > 0, rate.otherwise(tilt(F.col("size"), cap))).otherwise(0.0)
    rated = join_sources(docs, sources.select("source", "source_size", "target", "scale", "lam"), n_sources)
    rated = rated.withColumn("rate", F.round(rate * (1 << 20)) / (1 << 20)).drop("scale", "lam")
    u = (F.conv(F.substring("u", 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    place = F.floor(u / (u + F.col("rate") - F.floor("rate")) * float((1 << 48) - 1)).cast("long")
    return rated.withColumn("place", F.lpad(F.lower(F.hex(place)), 12, "0"))


def _slice(docs: DataFrame, wanted: DataFrame, n_sources: int, level: int) -> DataFrame:
    """One refinement: each source's open slice of docs, and the words before it."""
    here = F.substring("place", 1 + 3 * level, 3)
    sums = docs.groupBy("source", here.alias("slice")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("slice")
    run = join_sources(sums.withColumn("doc_id", F.col("slice")), wanted, n_sources).withColumn("upto", F.sum("words").over(upto))
    open_ = (
        run.filter(F.col("before") + F.col("upto") >= F.col("missing"))
        .groupBy("source")
        .agg(F.min_by(F.struct("slice", (F.col("before") + F.col("upto") - F.col("words")).alias("before")), "slice").alias("o"))
        .select("source", F.col("o.slice").alias("slice"), F.col("o.before").alias("open_before"))
    )
    return cut_lineage(open_)


def find_limits(docs: DataFrame, n_sources: int) -> DataFrame:
    """source and the place up to which its documents get one copy more (slice0, slice1, edge), from ``with_rates``;
    edge_more: how many of those equal to the edge, if not all.

    Documents whose rate has no fraction come last in the order and are left out.
    """
    missing = F.sum(F.col("size") * F.floor("rate"))
    wanted = cut_lineage(
        docs.groupBy("source").agg((F.max("target") - missing).alias("missing"), F.lit(0).cast("long").alias("before"))
    )
    limits, inside, bounds = wanted.select("source"), docs.filter("size > 0 AND rate > floor(rate)"), []
    for level in range(2):
        found = _slice(inside, wanted, n_sources, level)
        bounds.append(found.select("source", F.col("slice").alias(f"slice{level}")))
        here = F.substring("place", 1 + 3 * level, 3)
        inside = join_sources(inside, found.select("source", "slice"), n_sources).filter(here == F.col("slice")).drop("slice")
        wanted = join_sources(wanted.withColumn("doc_id", F.lit(0)), found, n_sources).select(
            "source", "missing", F.coalesce("open_before", "before").alias("before")
        )
    order = Window.partitionBy("source").orderBy("place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    equal = inside.groupBy("source", "place", "doc_id", "size").agg(F.count("*").alias("n"))
    last = join_sources(equal, wanted, n_sources).withColumn("upto", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    # The k-th of equal documents comes once more if half of it lies below what is missing.
    most = F.floor((2 * (F.col("missing") - F.col("upto")) + F.col("size")) / (2 * F.col("size")))
    last = last.withColumn("more", F.least(F.col("n"), most.cast("long"))).filter("more > 0")
    place = F.struct("place", "doc_id", "size")
    edges = cut_lineage(
        last.groupBy("source")
        .agg(F.max(F.struct(place.alias("edge"), "more", "n")).alias("e"))
        .select("source", F.col("e.edge").alias("edge"), F.when(F.col("e.more") < F.col("e.n"), F.col("e.more")).alias("edge_more"))
    )
    for more in (*bounds, edges):
        limits = join_sources(limits.withColumn("doc_id", F.lit(0)), more, n_sources).drop("doc_id")
    return cut_lineage(limits)


def take(docs: DataFrame, limits: DataFrame, n_sources: int) -> DataFrame:
    """docs (from ``with_rates``) with their ``copies``; nothing but limits, and equal documents that an edge cuts, is shuffled."""
    edge = F.struct("place", "doc_id", "size")
    a, b = F.substring("place", 1, 3), F.substring("place", 4, 3)
    below = (
        F.when(F.col("slice0").isNull() | (a < F.col("slice0")), True)
        .when(a > F.col("slice0"), False)
        .when(F.col("slice1").isNull() | (b < F.col("slice1")), True)
        .when(b > F.col("slice1"), False)
        .otherwise(F.coalesce(edge <= F.col("edge"), F.lit(False)))
    )
    more = (F.col("size") > 0) & (F.col("rate") > F.floor("rate")) & below
    copies = (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("long")
    found = join_sources(docs, limits, n_sources)
    kept = [c for c in docs.columns if c != "place"]
    whole = found.withColumn("copies", copies).select(*kept, "copies")
    if limits.filter("edge_more IS NOT NULL").isEmpty():
        return whole
    cut = more & F.col("edge_more").isNotNull() & edge.eqNullSafe(F.col("edge"))
    rows = cut_lineage(found.filter(cut).select(*kept, "edge_more"))
    rows = rows.withColumns({"_what": F.xxhash64(*kept), "_id": F.monotonically_increasing_id()})
    rows = running_sums(rows, [F.col("source").asc_nulls_last(), F.col("_what"), F.col("_id")], _number=F.lit(1))
    firsts = rows.groupBy("source").agg(F.min("_number").alias("_first"))
    rows = join_sources(rows, firsts, n_sources)
    again = F.when(F.col("_number") - F.col("_first") < F.col("edge_more"), 1).otherwise(0)
    numbered = rows.withColumn("copies", (F.floor("rate") + again).cast("long")).select(*kept, "copies")
    return found.filter(~cut).withColumn("copies", copies).select(*kept, "copies").unionByName(numbered)


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each row's size in words and ``u``, a random number in hex."""
    return df.withColumns({"size": word_count(text), "u": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})


def balance_sources(
    df: DataFrame, text: str = "text", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, u, source_size, target, rate and copies of every row of df.

    keep: more columns of df to return; with any, df's rows are read once more instead of being stored. A column named
    like one that is made is not kept.
    """
    made = {"doc_id", "source", "size", "u", "source_size", "target", "rate", "copies", "place", "slice0", "slice1", "edge", "edge_more", "scale", "lam"}
    keep = tuple(c for c in keep if c.lower() not in made)
    slim = sized(df, text).select("doc_id", "source", "size", "u")
    docs = cut_lineage(slim)
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(set_targets(cut_lineage(cycle_weights(totals, weights)), share, cap))
    n_sources = sources.count()
    solved = balance(docs, sources, n_sources, cap)
    limits = find_limits(with_rates(docs, solved, n_sources, cap), n_sources)
    rows = sized(df, text).select(*slim.columns, *keep) if keep else docs
    return take(with_rates(rows, solved, n_sources, cap), limits, n_sources)
