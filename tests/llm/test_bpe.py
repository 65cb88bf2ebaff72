import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from textloom.llm.bpe import decode, encode, load, round_trip
from textloom.llm.queries import op4_byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "  ", "   ", "a  b", "a   b", "a\n  b", "a \n b", "a\n \nb", " a", "a ", "a  ", "a  b", "　 x", "it's we'll I'M",
    "<|endoftext|> x", "é😀ßñ 日本語テキスト", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!" * 3000,
    "abab" * 800, "x1y2 " * 50 + "\t\r\n\x0b\x85", "THER!! HE&&& on*** | a", "\x00\x7f", "word" * 20000,
]


def test_like_tiktoken(spark, reference):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab  \n'tsé1.\t") for _ in range(rnd.randrange(1, 80))) for _ in range(400)]
    texts += ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in range(1, 140)]
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = decode(encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text), repr(text)[:80]
        assert bytes(r.decoded).decode() == text
    assert encode(df.limit(0), PATH, P.PATTERN).count() == 0
    once = {r.doc_id: (r.ids, bytes(r.decoded)) for r in round_trip(df, PATH, P.PATTERN).collect()}
    assert once == {r.doc_id: (r.ids, bytes(r.decoded)) for r in got}


def test_cache_may_overflow(monkeypatch, reference):
    from textloom.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    coder = bpe.ByteBpe(load(PATH, P.PATTERN).ranks, P.PATTERN)
    for text in ("one two three four five", "two six seven", "one two"):
        assert coder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_query_against_tiktoken(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in op4_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        want = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
