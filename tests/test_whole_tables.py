"""Registered queries on what only larger tables show."""

from textloom import plans
from textloom.plans import vector_queries as VQ
from textloom.streaming import ingest

from tests.oracle import DATA, compare


def test_tokenised_folder_counts_words_beyond_the_dictionary_s_usual_bound(spark, monkeypatch):
    monkeypatch.setattr(ingest.dictionary, "__defaults__", (10, 1))
    assert compare(spark, "s03_tokenised_folder", plans.QUERIES["s03_tokenised_folder"], plans.ORACLES["s03_tokenised_folder"]) > 10


def test_only_sampled_posts_have_vectors_made(spark, monkeypatch):
    given, made = [], VQ.E.sentence_vectors
    monkeypatch.setattr(VQ.E, "sentence_vectors", lambda rows, *more, **named: given.append(rows) or made(rows, *more, **named))
    kept = VQ.e05_sample(spark, DATA)
    assert kept.count() > 0
    assert given[0].count() < VQ.sentence_table(spark, DATA).count() / 2


def test_a_sentence_does_not_carry_the_words_of_its_post(spark):
    rows = VQ.E.sentence_vectors(VQ.sentence_table(spark, DATA).select("post_id", "sent", "words"), VQ.word_vectors(spark, DATA))
    found, below = [], [rows._jdf.queryExecution().optimizedPlan()]
    while below:
        node = below.pop()
        below += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName() == "Generate":
            found.append([node.requiredChildOutput().apply(i).name() for i in range(node.requiredChildOutput().size())])
    assert len(found) == 1 and "words" not in found[0], found
