import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import url_filter as u
from textloom.llm.queries import URL_RULES

RULES = "host string, path string, action string"
LIST = "host string, path string"


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.mark.parametrize(("n_listed", "n_all"), [(0, 50), (1, 1), (40, 40), (300, 5000), (2500, 5000), (1, 4000)])
def test_membership_is_exact(spark, n_listed, n_all):
    names = [f"host{k}.example/{k % 7}" for k in range(n_all)]
    listed = set(random.Random(n_listed).sample(names, n_listed))
    universe = keys(spark, names).repartition(3)
    cascade = u.build_cascade(keys(spark, [*listed, *listed, "not.in/universe"]), universe)
    told = {r["key"] for r in universe.filter(cascade.contains(F.col("key"))).collect()}
    assert told == listed
    if n_listed == 2500:
        assert len(cascade.levels) >= 4 and sum(x.bits for x in cascade.levels) < 12 * n_listed


def test_sizes_follow_the_counts():
    bits, hashes = u.size_level(1000, 0.5)
    assert hashes == 1 and 1443 <= bits <= 1443 + 64 and u.size_level(1, 1e-6)[1] == 20
    assert u.size_level(10, 3.0) == u.size_level(10, 0.5)


def judged(spark, urls, rules=URL_RULES, blocked=(), **more):
    pages = spark.createDataFrame([(k, x) for k, x in enumerate(urls)], "page_id long, url string")
    found = u.judge(pages, spark.createDataFrame(list(rules), RULES), spark.createDataFrame(list(blocked), LIST), **more)
    return [(r["host"], r["path"], r["rule"], r["listed"], r["verdict"]) for r in found.orderBy("page_id").collect()]


def brute(url, rules, blocked):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def best(entries):
        fit = [h + (p or "") for h, p in entries if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        return max(fit, key=len, default=None)

    rule, listed = best([r[:2] for r in rules]), best(blocked)
    blocks = any(h + p == rule and a == "block" for h, p, a in rules) if rule else listed is not None
    return host, path, rule, listed, "block" if blocks else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://?x", "http:///en/", "https://Example.NET/en/1", "http://a.b.example.net/de/", "http://example.net/En/",
    "http://notexample.net/en/", "http://example.net", "http://example.net?/en/", "http://x.example.com/de/1?q#f", "http://example.com/de", "http://org/fr/",
    "http://a.org/fr/x#y", "http://a.org/en/", "ftp://spam.example.org/x", "http://SPAM.example.org", "http://sub.spam.example.org#a", "http://xspam.example.org/",
    "http://é.example.org/a\nb", "http://net.", "a://b://c.net/", "http://a.org:80/fr/", "http://" + "a." * 500 + "net/" + "x" * 5000, "http://example.net/en/1",
]
BLOCKED = (("spam.example.org", ""), ("c.org", "/x"), ("spam.example.org", "/x"), (None, "/"), ("b.org", None), ("bad.org", "x"), ("", ""))


@pytest.mark.parametrize("max_bits", [u.MAX_BITS, 0])
def test_verdicts_equal_brute_force(spark, max_bits):
    blocked = [b for b in BLOCKED if b[0] and (not b[1] or b[1].startswith("/"))]
    assert judged(spark, URLS, blocked=BLOCKED, max_bits=max_bits) == [brute(x, URL_RULES, blocked) for x in URLS]


def test_rules_that_clash_and_empty_lists(spark):
    rules = (("a.net", "/", "allow"), ("a.net", "/", "block"), ("b.net", "/", None))
    got = judged(spark, ["http://a.net/", "http://b.net/", "http://c.net/"], rules)
    assert [g[2] for g in got] == ["a.net/", "b.net/", None] and [g[4] for g in got] == ["block", "allow", "allow"]
    assert [g[4] for g in judged(spark, ["http://a.net/", None], rules=())] == ["allow", "allow"]
    assert judged(spark, []) == []


def test_other_columns_pass_and_outputs_replace(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "x", "y", 5), (1, "http://a.net/", "x", "y", 5)], "page_id long, url string, Host string, verdict string, _key0 int")
    got = u.judge(pages, spark.createDataFrame(list(URL_RULES), RULES), spark.createDataFrame([], LIST)).collect()
    assert len(got) == 2 and got[0]["host"] == "a.net" and got[0]["verdict"] == "block" and got[0]["_key0"] == 5


def test_no_join_and_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.net/") for k in range(50)], "page_id long, url string")
    df = u.judge(pages, spark.createDataFrame(list(URL_RULES), RULES), spark.createDataFrame([("h3.net", ""), ("org", "")], LIST))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "Exchange", "Python", "Arrow"))
