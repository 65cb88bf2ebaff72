"""Batches of thousands of keyword searches: one automaton over the words of all of them, run once over each post.

The words of all terms and phrases are numbered, phrases become sequences of numbers, and an Aho-Corasick automaton over
these finds all of them in one walk over a post's tokens, whatever their number. A prefix is met by looking up the heads
of a batch's distinct tokens. Only what is found leaves a task: (part, post, tf, length), written once. Scores and tests are those of
``keyword.search_batch``, whose plan holds an expression for every part and so is meant for few.

The searches are a stated set, sent to the tasks after they are weighed. Keys of posts are longs that tell posts apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.keyword import Part, Query
from textloom.operators.postings import rank_parts
from textloom.session import stored

MAX_BYTES = 256 << 20
FOUND = "part int, post long, tf long, length long"


class Automaton:
    """All parts of one field."""

    def __init__(self, parts: dict[Part, int]):
        self.numbers: dict[str, int] = {}
        self.prefixes: dict[str, int] = {p.words[0]: i for p, i in parts.items() if p.prefix}
        self.widths = sorted({len(w) for w in self.prefixes})
        self.walk = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, i in parts.items():
            if not p.prefix:
                self.walk.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in p.words), i)
        self.some = len(self.walk) > 0
        if self.some:
            self.walk.make_automaton()

    def begun(self, token: str) -> list[int]:
        return [self.prefixes[token[:w]] for w in self.widths if token[:w] in self.prefixes and len(token) >= w]

    def find(self, tokens: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
        """part, place of the post, tf and length, for what is found in a batch of token lists."""
        codes = tokens.flatten().dictionary_encode()
        words = codes.dictionary.to_pylist()
        number = np.fromiter((self.numbers.get(w, 0) for w in words), np.int64, len(words))
        heads = [self.begun(w) for w in words] if self.prefixes else []
        of = codes.indices.to_numpy(zero_copy_only=False)
        # Only tokens that some part has are looked at: the others are 0 and end what was begun.
        useful = number > 0
        if heads:
            useful = useful | np.fromiter((bool(h) for h in heads), bool, len(words))
        lengths = np.diff(tokens.offsets.to_numpy()) * tokens.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        out: tuple[list[int], ...] = ([], [], [], [])
        hits = np.concatenate([[0], np.cumsum(useful[of])]) if len(of) else np.zeros(1, int)
        for k in np.flatnonzero(hits[ends] > hits[ends - lengths]):
            own = of[ends[k] - lengths[k] : ends[k]]
            counts: dict[int, int] = {}
            if self.some:
                for _, part in self.walk.iter(tuple(number[own].tolist())):
                    counts[part] = counts.get(part, 0) + 1
            if heads:
                for code in own.tolist():
                    for part in heads[code]:
                        counts[part] = counts.get(part, 0) + 1
            for part, tf in counts.items():
                for column, value in zip(out, (part, int(k), tf, int(lengths[k]))):
                    column.append(value)
        return out


def search_many(posts: DataFrame, queries: Sequence[Query], k: int = 10, key: str = "post_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(query_id, key, score, rank): the k best of posts (analysed) for each query, in one pass over them."""
    spark = posts.sparkSession
    own = {i: [p for p in q if p is not None] for i, q in enumerate(queries)}
    own = {i: q for i, q in own.items() if any(p.need != "not" for p in q)}
    if not own:
        return spark.createDataFrame([], f"query_id long, {key} long, score double, rank long")
    parts = {p: i for i, p in enumerate(dict.fromkeys(replace(p, need="may") for q in own.values() for p in q))}
    if (weight := sum(200 + sum(len(w.encode()) + 100 for w in p.words) for p in parts)) > max_bytes:
        raise ValueError(f"the searches take about {weight} bytes: search them in several batches")
    fields = {f: {p: i for p, i in parts.items() if p.field == f} for f in {p.field for p in parts}}
    shared = spark.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {f: Automaton(ps) for f, ps in shared.value.items()}
        for batch in batches:
            for f, automaton in automata.items():
                part, place, tf, length = automaton.find(batch.column(f"tokens_{f}"))
                columns = [pa.array(part, pa.int32()), batch.column("post").take(pa.array(place, pa.int64())), pa.array(tf, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "post", "tf", "length"])

    slim = posts.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("post"), *(f"tokens_{f}" for f in fields))
    found = stored(slim.mapInArrow(run, FOUND), "saved-searches")
    df = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part of the stated set
    return rank_parts(found, parts, own, posts.count(), df, k, key)
