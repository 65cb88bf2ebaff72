"""Sparse matrices as files of compressed columns: a data source ``sparse_columns`` of entries (row, col, value).

Files are Arrow files with lz4: a record batch has the column numbers of up to ``ENTRIES`` entries, a list of row ids for each of
them and a list of values. Entries are sorted by column and row over range partitions, each of which streams into one file, so a
column however long is cut over batches and files, and nothing but a batch is held. A manifest names the files that count, with
their first and last column, and is written when all are complete: tasks that ran twice, and writes that broke off, leave no entry.
``append`` adds files to the manifest, ``overwrite`` begins a new one.

Reading takes a task a file. ``first`` and ``last`` (columns, both included) leave out files and batches before they are decoded; so
do conditions on ``col`` where the session lets Python sources see them (spark.sql.python.filterPushdown.enabled).

Entries with a null row, column or value are none. Repeated entries stay as they are: add them up before, if they should be.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

from textloom.sources import arrays

ENTRIES = 1_000_000
MANIFEST = "manifest.json"
SCHEMA = "row long, col long, value double"
_STORED = pa.schema([("col", pa.int64()), ("rows", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])
_READ = pa.schema([("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64())])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    first: int
    last: int
    entries: int


def _manifest(path: str) -> list[dict]:
    store, root = arrays.files(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    return json.loads(arrays.get(path, MANIFEST))


def _packed(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.diff(col, prepend=col[0] - 1))
    offsets = pa.array(np.append(starts, len(col)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (row, value)]
    return pa.RecordBatch.from_arrays([pa.array(col[starts]), *lists], schema=_STORED)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, entries: int):
        self.path, self.overwrite, self.entries = path, overwrite, entries

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = arrays.files(self.path)
        store.create_dir(root, recursive=True)
        name, first, last, n = f"{uuid.uuid4().hex}.arrow", None, None, 0
        options = pa.ipc.IpcWriteOptions(compression="lz4")
        sink = out = None
        for batch in iterator:
            for begin in range(0, batch.num_rows, self.entries):
                piece = batch.slice(begin, self.entries)
                row, col, value = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "value"))
                if out is None:
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                    out = pa.ipc.new_file(sink, _STORED, options=options)
                    first = int(col[0])
                out.write_batch(_packed(row, col, value))
                last, n = int(col[-1]), n + len(col)
        if out is None:
            return Written(None, 0, 0, 0)
        out.close()
        sink.close()
        return Written(name, first, last, n)

    def commit(self, messages: list[Written | None]) -> None:
        old = [] if self.overwrite else _manifest(self.path)
        new = [vars(m) for m in messages if m is not None and m.file]
        arrays.put(self.path, MANIFEST, json.dumps(old + new).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = arrays.files(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class Columns(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, path: str, first: int | None, last: int | None):
        self.path, self.first, self.last = path, first, last

    def _outside(self, first: int, last: int) -> bool:
        return (self.first is not None and last < self.first) or (self.last is not None and first > self.last)

    def partitions(self) -> list[Columns]:
        return [Columns(m["file"]) for m in _manifest(self.path) if not self._outside(m["first"], m["last"])] or [Columns("")]

    def read(self, partition: Columns) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = arrays.files(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as source:
            found = pa.ipc.open_file(source)
            for k in range(found.num_record_batches):
                batch = found.get_batch(k)
                col = batch.column("col").to_numpy()
                begin = 0 if self.first is None else int(np.searchsorted(col, self.first))
                stop = len(col) if self.last is None else int(np.searchsorted(col, self.last, "right"))
                if begin < stop:
                    own = batch.slice(begin, stop - begin)
                    lengths = pc.list_value_length(own.column("rows")).to_numpy()
                    flat = [own.column("rows").flatten(), pa.array(np.repeat(col[begin:stop], lengths)), own.column("values").flatten()]
                    yield pa.RecordBatch.from_arrays(flat, schema=_READ)


class FilteredReader(Reader):
    """For sessions that show conditions to Python sources: others refuse a reader that asks for them."""

    def _within(self, first: int | None, last: int | None) -> None:
        if first is not None:
            self.first = first if self.first is None else max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on col narrow the range; Spark tests all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("col",):
                if isinstance(f, EqualTo):
                    self._within(f.value, f.value)
                elif isinstance(f, In):
                    given = [v for v in f.value if v is not None]
                    if given:
                        self._within(min(given), max(given))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._within(f.value, None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._within(None, f.value)
            yield f


class SparseColumns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparse_columns"

    def schema(self) -> str:
        return SCHEMA

    def _range(self) -> tuple[int | None, int | None]:
        return tuple(int(self.options[k]) if self.options.get(k) is not None else None for k in ("first", "last"))

    def reader(self, schema) -> Reader:
        kind = FilteredReader if self.options.get("filtered") == "true" else Reader
        return kind(self.options["path"], *self._range())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("entries", ENTRIES)))


def write_matrix(
    entries: DataFrame, path: str, row: str = "row", col: str = "col", value: str = "value", mode: str = "append", files: int | None = None
) -> None:
    """Entries sorted into ranges of columns (and of rows, inside a long column), one file a range."""
    entries.sparkSession.dataSource.register(SparseColumns)
    plain = entries.select(F.col(row).cast("long").alias("row"), F.col(col).cast("long").alias("col"), F.col(value).cast("double").alias("value")).dropna()
    dealt = plain.repartitionByRange(files, "col", "row") if files else plain.repartitionByRange("col", "row")
    dealt.sortWithinPartitions("col", "row").write.format("sparse_columns").mode(mode).save(path)


def read_matrix(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(row, col, value) of the columns from first to last, both included, or of all."""
    spark.dataSource.register(SparseColumns)
    reader = spark.read.format("sparse_columns").option("filtered", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, at in (("first", first), ("last", last)):
        reader = reader if at is None else reader.option(name, at)
    return reader.load(path)
