import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tests.llm.test_secret_scan import brute
from tests.llm.test_simhash import classes, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = [r.asDict() for r in docs.collect()]
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out["quality"]}
    good = [i for i, y in labels.items() if y == 1]
    bad = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
    assert all(r["text"] == first[r["doc_id"]] for r in out["quality"])

    fps = {i: plain_fingerprint(first[i]) for i in kept}
    label, least = classes(sorted(set(fps.values()))), {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert sorted(r["doc_id"] for r in out["near_copies"]) == sorted(least.values())

    assert len(out["secrets"]) == len(out["near_copies"])
    for r in out["secrets"]:
        text, at, parts = first[r["doc_id"]], 0, []
        for start, _, _, end in brute(text):
            if start <= at and parts:
                at = max(at, end)
                continue
            parts += [text[at:start], "[SECRET]"]
            at = end
        assert r["text"] == "".join(parts) + text[at:] and r["n_chars"] == len(r["text"])

    after = {r["doc_id"]: r for r in out["secrets"]}
    assert all(r == after[r["doc_id"]] for r in out["mixture"])
    size = lambda r: len(r["text"].encode().split())
    assert abs(sum(map(size, out["mixture"])) / sum(map(size, out["secrets"])) - 1.5) < 0.05

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(out["tokens"]) == len(out["mixture"])
    for r in out["tokens"]:
        text = after[r["doc_id"]]["text"]
        assert r["ids"] == plain.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string"
    rows = [(1, None, None, None, None, "x", "y"), (None, "a secret=abcdefgh1 b", "en", "s", 3, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, "w " * 300, "en", "t", 600, "x", "y")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in C.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "tokens" or set(got.columns) == set(C.COLUMNS)
            assert got.count() <= 2 * n
