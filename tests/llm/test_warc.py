import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import warc

SCHEMA = "page_id long, url string, html string, path string, data int"


def test_round_trip(spark):
    big = "é😀x" * 100000
    pages = [(1, "http://a/\r\nX: y", "<p>", "?", 1), (5, None, None, "?", 1), (4, "u", "", "?", 1), (9, "u", "<p>", "?", 1), (7, "u", big, "?", 1),
             (None, "u", "<p>", "?", 1), (None, "u", "only", "?", 1), (8, "u", "\r\n\r\nWARC/1.1\r\n", "?", 1), (1, "u", "<p>", "?", 1)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    archives, folder = warc.archive_pages(spark, df)
    chunks = warc.read_archives(archives, folder, chunk_bytes=1000).cache()
    got = warc.records(chunks).collect()
    assert len(got) == len(pages)
    tasks = chunks.select(F.spark_partition_id().alias("t"), "path").distinct().groupBy("t").count().collect()
    assert len(tasks) == archives.count() and all(r["count"] == 1 for r in tasks)
    first = {None: None}
    for i, _, html, _, _ in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _, _ in pages:
        payload = (html or "").encode()
        refers = first.get(html or "")
        kind = "response" if refers == i else "revisit"
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, refers if kind == "revisit" else None))
    key = lambda r: repr(r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    parts = sorted((r.chunk_no, bytes(r.data)) for r in chunks.filter("page_id = 7").collect())
    assert b"".join(d for _, d in parts) == big.encode() and max(len(d) for _, d in parts) <= 1000
    for r in archives.collect():  # any gzip reader sees whole records
        assert gzip.open(r.path).read().count(b"WARC/1.1\r\nWARC-Type") == r.records


def test_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], SCHEMA)
    archives, folder = warc.archive_pages(spark, df, min_revisit_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.records(warc.read_archives(archives, folder)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    archives, folder = warc.archive_pages(spark, df.limit(0))
    assert warc.records(warc.read_archives(archives, folder)).count() == 0


def test_broken_records_are_errors(spark):
    df = spark.createDataFrame([(1, "u", "abc" * 1000, "", 0), (2, "u", "xyz", "", 0)], SCHEMA).coalesce(1)
    archives, folder = warc.archive_pages(spark, df)
    chunks = warc.read_archives(archives, folder, chunk_bytes=1000)
    assert warc.records(chunks).count() == 2
    for spoilt in (
        chunks.filter("chunk_no <> 1"),
        chunks.filter("NOT (page_id = 1 AND chunk_no = 2)"),
        chunks.withColumn("declared_digest", F.lit("A" * 32)),
        chunks.withColumn("declared_bytes", F.col("declared_bytes") + 1),
    ):
        with pytest.raises(Exception, match="broken record"):
            warc.records(spoilt).collect()


def test_salts_grow_with_copies(spark):
    """One payload on all pages, in more salts than the least number."""
    df = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "'same' AS html")
    got = warc.assign_records(df, rows_per_salt=10).collect()
    assert len(got) == 400 and {r.first for r in got} == {0}
