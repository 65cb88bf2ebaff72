"""What one task does in one pass over its sentences, without a session."""

from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from textloom.operators import embedding as E
from textloom.operators import semantic as Q

HELD = SimpleNamespace(value=(["a", "b", "c"], np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])))
UNITS = np.array([[1.0, 0.0], [0.0, 1.0]])
PARTS = [[["a"], ["b", "b"], ["c"]], [], [["a", "x"], None, ["a", "b"], []]]
HALF = 0.5**0.5


def run(parts, *more, **named):
    batches = (pa.array(rows, pa.list_(pa.string())) for rows in parts)
    return [r for out in E._pass(HELD, *more, **named)(batches) for r in out.to_pylist()]


def test_vectors_and_scores_of_each_row():
    assert run(PARTS, lambda units: units) == [[1, 0], [0, 1], None, [1, 0], None, pytest.approx([HALF, HALF]), None]
    assert run(PARTS, lambda units: units @ UNITS[:, :1], missing=0.0) == [[1], [0], [0], [1], [0], [pytest.approx(HALF)], [0]]
    assert run([[]], lambda units: units @ UNITS, missing=0.0, stays=partial(Q.Levels, 1)) == []


def test_scores_below_the_best_are_left_out_and_equals_stay():
    """q03_dedupe_before: all rows of a score that stays go on, so that the first can hide the others."""
    got = run(PARTS, lambda units: units @ UNITS, stays=partial(Q.Levels, 1))
    assert got == [[1, None], [None, 1], None, [1, None], None, None, None]
    assert run(PARTS, lambda units: units @ UNITS, stays=partial(Q.Levels, 2))[5] == pytest.approx([HALF, HALF])


def test_sentence_without_a_vector_has_the_score_given():
    """q07_multi_query: such sentences score 0, unless that can't be among the best."""
    whole = lambda units: units @ np.array([[1.0], [-1.0]])
    assert run(PARTS, whole, missing=0.0, stays=partial(Q.Levels, 2)) == [[1], None, [0], [1], [0], [0], [0]]
    assert run(PARTS, whole, missing=0.0, stays=partial(Q.Levels, 1)) == [[1], None, None, [1], None, None, None]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_what_stays_holds_the_best_scores(size):
    rng = np.random.default_rng(2)
    rows = [[("a", "b", "x")[w] for w in rng.integers(0, 3, 9)] for _ in range(600)]
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    every, some = (run(parts, lambda units: units @ UNITS, **named) for named in ({}, {"stays": partial(Q.Levels, 5)}))
    for q in range(2):
        full = [None if r is None else r[q] for r in every]
        kept = [None if r is None else r[q] for r in some]
        assert all(k is None or k == f for k, f in zip(kept, full, strict=True))
        best = sorted({round(f, 6) for f in full if f is not None})[-5:]
        assert all(k is not None for k, f in zip(kept, full) if f is not None and round(f, 6) in best)
        assert sum(k is not None for k in kept) < sum(f is not None for f in full)


def test_no_numbers_come_first_and_infinite_ones_have_their_place():
    stays = Q.Levels(2)(np.array([[0.5], [np.nan], [np.inf], [-np.inf], [0.1]]))
    assert stays[:, 0].tolist() == [False, True, True, False, False]
