"""Queries do the whole job: no row is left out to make a check cheap."""

from pyspark.sql import functions as F
from textloom import plans
from textloom.plans.registry import posts
from textloom.plans.vector_queries import word_vectors

from tests.oracle import DATA


def test_every_post_is_weighted(spark):
    got = {r.post_id for r in plans.QUERIES["w05_square_root"](spark, DATA).select("post_id").distinct().collect()}
    assert got == {r.post_id for r in posts(spark, DATA).filter(F.size("words") > 0).select("post_id").collect()}


def test_every_sentence_has_its_user(spark):
    rows = plans.QUERIES["j04_sentence_users"](spark, DATA)
    assert rows.count() == plans.QUERIES["f02_sentences"](spark, DATA).count()


def test_every_embedding_has_its_word(spark, tmp_path):
    n = 5200
    letters = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(n)]
    docs = [(k, "s", "en", " ".join(letters[k::4])) for k in range(4)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0]) for i in range(n)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert word_vectors(spark, str(tmp_path)).count() == n
