"""Searches shuffle few rows: each task keeps its own best. Before, each shuffled a row for every distinct score."""

import pytest
from textloom import plans

from tests.oracle import DATA
from tests.test_best_rows import shuffled


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("q03_semantic_topk", 900),
        ("q08_plain", 1500),
        ("q13_unit_words", 900),
        ("e03_stop_words", 900),
        ("p07_exclude_regex", 2500),
        ("p07_exclude_words", 2500),
        ("q04_query_sample", 900),
    ],
)
def test_few_sentences_are_shuffled(spark, name, most):
    assert 0 < shuffled(plans.QUERIES[name](spark, DATA)) <= most
