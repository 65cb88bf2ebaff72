"""Sentence vectors by joins: whole rows are shuffled, words and sums are not."""

import pytest
from textloom.operators import embedding as E

from tests.test_best_rows import many, shuffled  # noqa: F401


def test_only_whole_rows_are_shuffled(many):  # noqa: F811
    rows, vectors = many
    joined = E.sentence_vectors(rows, vectors, method="join")
    assert shuffled(joined) <= 8_000  # each of 4,000 rows twice at most; they have 8,000 words
    a, b = ({r["post_id"]: r["vector"] for r in x.collect()} for x in (joined, E.sentence_vectors(rows, vectors)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
