"""From raw documents to token ids: five stages over whole tables, each one's rows being the next one's input.

quality     documents that the quality classifier rejects go
near_copies one document of each component of near duplicates stays
secrets     secrets are replaced by a mark; no document goes
mixture     sources are brought to their target weights: a document comes out as often as the mix takes it
tokens      every text is encoded by byte-level BPE; the ids decode to the text's bytes

A stage takes null columns, empty tables, repeated rows and extra columns as its operator does; extra columns
are not returned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, mixing, quality_model, secret_scan, simhash
from textloom.llm.common import table
from textloom.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(quality_model.fold() != 0)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.filter(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.balance_sources(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    copies = mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    path, pattern = public_tokenizers.path(vocabulary), public_tokenizers.PATTERN
    decoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A trained network and fingerprints of graphs aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
