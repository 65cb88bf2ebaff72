"""Conversation structure repair: the cheapest edits that give a conversation the role initials (s?(ua)+)?.

Order and faults. A conversation's rows are taken by turn (nulls first), then role, then text, so that repeated rows
stand together. A row's first fault counts: blank (no character but spaces), duplicate (role and text seen earlier in the
conversation), truncated (its last character but spaces is none of ``.!?``). Equal rows are counted before they are
shuffled on; earlier texts are found by the least turn of each (conversation, role, digest) that occurs in two rows or more, joined
so that adaptive execution can split a hot key; and the order is made by range partitions over (conversation, turn, role,
head of the text), so a conversation with a third of all rows lies in many of them.

Edits. Keep costs 0, Rerole (to user or assistant) 3, Delete 4 (required for blank and duplicate rows), Insert (an empty
user or assistant row, anywhere) 3; a truncated row that stays adds 3. Of the cheapest edits those whose initials
(the audit) are ASCII-least are taken. An audit fixes the roles, since only a kept first row can be ``s``; two different
audits of the same rows, cost and grammar state are never prefixes of each other, so the least audit of a state may be
kept as rows are added.

Recursion. Rows become symbols (initial and fault). Blocks of at most ``BLOCK`` consecutive rows are dealt by hash; within a
batch one recursive DuckDB query advances one row of every block in each recursion and keeps for each of the four grammar
states the least (cost, audit), once for each state that a block may begin in. Blocks are then chained conversation by
conversation, each as one step. What one task holds of a conversation is its audit, about five bytes a row; texts
are not held. The edits go back to the rows block by block.

Digest. ``digest`` reads repaired rows in order, as a stream; a conversation's digest is one sequence by nature.

A null role or text is one space, a null turn is a turn before all others; a null conversation is a conversation. Any
types of ids and turns that sort will do. Rows of other roles are reroled or deleted. Extra columns are not returned.
A conversation without rows has an empty audit, and an empty table no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import pooled

SPACE = r"[\x20\x09-\x0D]"
BLOCK = 64
BATCH_BYTES = 64 << 10  # of symbols and keys that one recursive query gets: it keeps BLOCK rows a block and start
HEAD = 32
#: Symbols by fault (none, truncated, duplicate, blank) and initial (s, u, a, other).
SYMBOLS = ("suao", "SUAO", "wxyz", "0123")
_INITIALS = str.maketrans("".join(SYMBOLS), "suao" * 4)
STATES = range(4)  # nothing yet, after s, after u, after a
_FAR = 1 << 30

_ADVANCE = f"""
WITH RECURSIVE dp AS (
  SELECT k, symbols, s AS start, 0 AS i,
         {", ".join(f"{{'c': CASE WHEN s = {t} THEN 0 ELSE {_FAR} END, 'a': ''}} AS v{t}" for t in STATES)}
  FROM blocks, range(4) AS t(s)
  UNION ALL
  SELECT k, symbols, start, i + 1, put(v0, 4, 'D'),
         CASE WHEN y = 's' THEN least(put(v1, 4, 'D'), put(v0, late, 'K')) ELSE put(v1, 4, 'D') END,
         CASE WHEN gone THEN put(w2, 4, 'D')
              WHEN y = 'u' THEN least(put(w2, 4, 'D'), put(least(v0, v1, w3), late, 'K'))
              ELSE least(put(w2, 4, 'D'), put(least(v0, v1, w3), late + 3, 'R')) END,
         CASE WHEN gone THEN put(w3, 4, 'D')
              WHEN y = 'a' THEN least(put(w3, 4, 'D'), put(w2, late, 'K'))
              ELSE least(put(w3, 4, 'D'), put(w2, late + 3, 'R')) END
  FROM (
    SELECT *, least(v3, put(w2, 3, 'I')) AS w3, x IN ({", ".join(f"'{c}'" for c in SYMBOLS[2] + SYMBOLS[3])}) AS gone,
           CASE WHEN x IN ('S', 'U', 'A', 'O') THEN 3 ELSE 0 END AS late, lower(x) AS y
    FROM (
      SELECT *, substr(symbols, i + 1, 1) AS x, least(v2, put(v0, 3, 'I'), put(v1, 3, 'I'), put(v3, 3, 'I')) AS w2
      FROM dp WHERE i < length(symbols)
    )
  )
)
SELECT k, start, [v0.c, v1.c, v2.c, v3.c] AS costs, [v0.a, v1.a, v2.a, v3.a] AS audits FROM dp WHERE i = length(symbols)
ORDER BY k, start
"""


def solver() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1})
    con.execute("SET temp_directory = ''")
    con.execute("CREATE MACRO put(v, cost, letter) AS {'c': v.c + cost, 'a': v.a || letter}")
    return con


def advance(con: duckdb.DuckDBPyConnection, symbols: pa.Array) -> list[list[tuple[list[int], list[str]]]]:
    """For each block of symbols and each state it begins in: the least cost and audit of each state it ends in."""
    con.register("blocks", pa.table({"k": pa.array(range(len(symbols)), pa.int64()), "symbols": symbols}))
    rows = con.execute(_ADVANCE).fetchall()
    return [[(c, a) for _, _, c, a in rows[4 * k : 4 * k + 4]] for k in range(len(symbols))]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often the row comes (``copies``, 0 if it is dropped), by crc32(conv_id:turn) % 20."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def turn_gaps(rows: DataFrame) -> DataFrame:
    """conv_id of every row, and ``gaps``: turns missing between the least and the greatest of those that come."""
    turns = rows.groupBy("conv_id", "turn").agg((F.max("copies") > 0).alias("here"))
    turn = F.when(F.col("here"), F.col("turn"))
    missing = F.max(turn) - F.min(turn) + 1 - F.count(turn)
    return turns.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]


def place(rows: DataFrame) -> DataFrame:
    """conv_id, role, text, symbol and ``at``, which orders all rows, of the rows that come."""
    counted = (
        rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5("text"))
    )
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = counted.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    found = counted.join(again, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    seen = (F.col("copy") > 1) | F.coalesce(turn > F.col("first"), F.lit(False))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 3).when(seen, 2).when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), 1).otherwise(0)
    )
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.col("role") != "") & (initial > 0), initial).otherwise(4)
    symbol = F.substring(F.lit("".join(SYMBOLS)), fault * 4 + initial, F.lit(1))
    found = found.withColumns({"symbol": symbol, "head": F.substring("text", 1, HEAD)})
    dealt = found.repartitionByRange(*_order(), F.col("head")).sortWithinPartitions(*_order(), "text", "copy")
    return dealt.select("conv_id", "role", F.when(F.col("copy") == 1, F.col("text")).otherwise("").alias("text"), "symbol", F.monotonically_increasing_id().alias("at"))


def _block() -> Column:
    return F.expr(f"at div {BLOCK}")


def block_costs(placed: DataFrame) -> DataFrame:
    """conv_id, block, symbols, and costs and audits of its 16 pairs of states."""
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda r: r["symbol"]), "")
    # As many tasks as the texts have: symbols are few bytes, but each is worked on.
    dealt = placed.repartition(max(1, placed.rdd.getNumPartitions()), "conv_id", _block())
    blocks = dealt.groupBy("conv_id", _block().alias("block")).agg(symbols.alias("symbols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = solver()
        for batch in pooled(_sliced(batches), BATCH_BYTES):
            solved = advance(con, batch.column("symbols"))
            costs = pa.array([[c for v, _ in s for c in v] for s in solved], pa.list_(pa.int64()))
            audits = pa.array([[a for _, v in s for a in v] for s in solved], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, audits], names=[*batch.schema.names, "costs", "audits"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema, *T.StructType.fromDDL("costs array<long>, audits array<string>")]))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


class Chain:
    """The blocks of one conversation, taken in order."""

    def __init__(self) -> None:
        self.best: list[tuple[int, str]] = [(0, ""), *[(_FAR, "")] * 3]
        self.lengths: list[int] = []
        self.blocks: list[int] = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.last = ""

    def add(self, block: int, symbols: str, costs: list[int], audits: list[str]) -> None:
        ways = [[(c + costs[4 * s + t], a, audits[4 * s + t]) for s, (c, a) in enumerate(self.best) if c < _FAR and costs[4 * s + t] < _FAR] for t in STATES]
        self.best = [min(((c, a + b) for c, a, b in w if c == min(x[0] for x in w)), default=(_FAR, "")) for w in ways]
        for k, kind in enumerate((SYMBOLS[3], SYMBOLS[2], SYMBOLS[1])):
            self.counts[k] += sum(map(symbols.count, kind))
        initials = self.last + symbols.translate(_INITIALS)
        self.counts[3] += len(initials) - 1 - sum(map(initials.count, ("su", "ua", "au")))
        self.last = initials[-1]
        self.blocks.append(block)
        self.lengths.append(len(symbols))

    def end(self) -> tuple[int, str]:
        (c0, a0), (c1, a1), (c2, a2), (c3, a3) = self.best
        return min((c0, a0), (c3, a3), (c2 + 3, a2 + "I"), (c1 + 6, a1 + "II"))

    def pieces(self, audit: str) -> Iterator[tuple[int, int, str]]:
        """Each block, the state it begins in, and its part of the audit; an Insert belongs to the row after it."""
        at = state = 0
        # Only a kept first row can be ``s``: then the rows that come out are odd in number.
        first = 1 if (len(audit) - audit.count("D")) % 2 else 2
        for k, (block, length) in enumerate(zip(self.blocks, self.lengths)):
            stop, left = at, length
            while left:
                left -= audit[stop] != "I"
                stop += 1
            if k + 1 == len(self.blocks):
                stop = len(audit)
            yield block, state, audit[at:stop]
            for letter in audit[at:stop]:
                state = state if letter == "D" else first if state == 0 else 3 if state == 2 else 2
            at = stop


def chain(blocks: DataFrame) -> DataFrame:
    """For each conversation a row without a block (counts, cost, audit) and a row a block (state, piece of the audit)."""
    ids = [blocks.schema["conv_id"]]
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([*ids, *T.StructType.fromDDL("block long, state int, audit string, " + ", ".join(f"{n} long" for n in names))])

    def rows(conv: pa.Array, chained: Chain) -> pa.RecordBatch:
        cost, audit = chained.end()
        parts = list(chained.pieces(audit))
        columns = [[None, *(p[0] for p in parts)], [None, *(p[1] for p in parts)], [audit, *(p[2] for p in parts)]]
        columns += [[x, *[None] * len(parts)] for x in (*chained.counts, cost)]
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
        whole = pa.concat_arrays([conv] * (len(parts) + 1))
        return pa.RecordBatch.from_arrays([whole, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chained = None, None
        for batch in batches:
            fields = zip(*(batch.column(c).to_pylist() for c in ("block", "symbols", "costs", "audits")))
            for k, (block, symbols, costs, audits) in enumerate(fields):
                here = batch.column("conv_id").slice(k, 1)
                if conv is None or here[0] != conv[0] and not (here.null_count and conv.null_count):
                    if chained:
                        yield rows(conv, chained)
                    conv, chained = here, Chain()
                chained.add(block, symbols, costs, audits)
        if chained:
            yield rows(conv, chained)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lambda b: _merged(run(b)), schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many small batches as fewer larger ones."""
    return pooled(batches, 1 << 20)


def edit_rows(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id, at, part, role, text and edit of the rows that a conversation has after its edits, inserted ones included.

    A block's piece of the audit is sent before its rows, to the same task.
    """
    ids = [placed.schema["conv_id"]]
    schema = T.StructType([*ids, *T.StructType.fromDDL("at long, part int, role string, text string, edit string")])
    told = pieces.select("conv_id", "block", F.lit(None).cast("long").alias("at"), "state", F.col("audit").alias("role"), F.lit("").alias("text"))
    rows = placed.select("conv_id", _block().alias("block"), "at", F.lit(None).cast("int").alias("state"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, place, state, last = "", 0, 0, 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def put(k: int, at: int, part: int, role: str, text: str, edit: str) -> None:
                for column, value in zip(out, (k, at, part, role, text, edit)):  # noqa: B023
                    column.append(value)

            def inserts(k: int, at: int, part: int) -> int:
                nonlocal place, state
                while place < len(audit) and audit[place] == "I":
                    state = 3 if state == 2 else 2
                    put(k, at, part, "assistant" if state == 3 else "user", "", "I")
                    place, part = place + 1, part + 1
                return part

            for k, (at, begin, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "state", "role", "text")))):
                if at is None:
                    audit, place, state = role, 0, begin
                    # Inserts after the last row of a conversation follow it.
                    last = len(audit.rstrip("I"))
                    continue
                part = inserts(k, at, 0)
                edit, place = audit[place], place + 1
                if edit != "D":
                    if edit == "K":
                        state = {"s": 1, "u": 2}.get(role[0], 3)
                    else:
                        state = 3 if state == 2 else 2
                        role = "assistant" if state == 3 else "user"
                    put(k, at, part, role, text, edit)
                    part += 1
                if place == last:
                    inserts(k, at, part)
            ids_ = batch.column("conv_id").take(pa.array(out[0], pa.int64()))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(c, t) for c, t in zip(out[1:], kinds))], names=schema.names)

    dealt = rows.unionByName(told).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("at").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


class Repair(NamedTuple):
    """report: a row a conversation; rows: the repaired conversations' rows, in the order of (at, part)."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame) -> Repair:
    """rows: conv_id, turn, role, text and, if a row comes not once, ``copies``."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    slim = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), copies.alias("copies"))
    placed = cut_lineage(place(slim))
    chained = cut_lineage(chain(block_costs(placed)))
    told = chained.filter("block IS NULL").select(F.col("conv_id").alias("_conv"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    report = turn_gaps(slim).join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    report = report.fillna(0, ["blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"])
    return Repair(report, edit_rows(placed, chained.filter("block IS NOT NULL")))


def digest(rows: DataFrame, out: str = "repaired_sha256") -> DataFrame:
    """conv_id and the SHA-256 of its rows as role:text, joined by newlines."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ids, done = batch.column("conv_id"), []
            for k, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())):
                here = ids.slice(k, 1)
                if state is None or here[0] != conv[0] and not (here.null_count and conv.null_count):
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = here, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c for c, _ in done]), pa.array([h for _, h in done], pa.string())], names=schema.names)
        if state:
            yield pa.RecordBatch.from_arrays([conv, pa.array([state.hexdigest()], pa.string())], names=schema.names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part").mapInArrow(run, schema)
