"""The queries of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, chat_repair, lz_fingerprint, mixing, ngram_lm, quality_model, secret_scan, simhash, url_filter, warc, whitening
from .common import table
from .quality_rules import RULES, STOP_WORDS, apply_rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rules_sql() -> str:
    tests = []
    for rule in RULES:
        if rule.low is not None:
            tests.append(f"(n_words > 0 AND {rule.metric} < {rule.low})")
        if rule.high is not None:
            tests.append(f"(n_words > 0 AND {rule.metric} > {rule.high})")
    return " OR ".join(tests)


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM g, range(3) AS t(o) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop,
         len(ls) AS n_lines, len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...'))) AS n_ell
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), q AS (
  SELECT *, word_chars / greatest(n_words, 1) AS word_chars_per_word, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_stop / greatest(n_words, 1) AS stop_words_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_lines_per_line,
         n_ell / greatest(n_lines, 1) AS ellipsis_lines_per_line,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_rules_sql()}) AS kept
FROM q
"""

def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(ngram_lm.remainder() == 2, F.lit(False))
    trie = ngram_lm.train(docs.filter(~held_out).select("text"), order=3)
    return ngram_lm.score(docs, trie).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(trie.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = warc.archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    read = warc.records(warc.read_archives(archives, folder))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {5 * (k // 4) + 1}, 5))::BIGINT >> {15 - 5 * (k % 4)}) & 31 AS BIGINT) + 1, 1)"
    for k in range(32)
)
OP2_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    chats = chat_format.format_chats(rows)
    read = chats.withColumn("turns", chat_format.read_chats(F.col("formatted"))).withColumn(
        "loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|sep>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"
OP3_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), o AS (
  SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w <> role, true) AS begins,
         coalesce(lead(role) OVER w <> role, true) AS ends
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("text")}) + CASE WHEN ends THEN 4 ELSE 0 END
           + CASE WHEN begins THEN 4 + length({_ESCAPED.format("role")}) ELSE 5 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    path, pattern = public_tokenizers.path(vocabulary), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.balance_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, avg(size) FILTER (size > 0) AS scale FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s
), f AS (  -- in the order of size by weight, the first sources stop at twice their size
  SELECT *, 1.5 * sum(source_size) OVER () AS total,
         coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), l AS (
  SELECT first((total - used) / rest ORDER BY k) AS level, first(k ORDER BY k) AS k0
  FROM f WHERE (total - used) / rest * weight <= 2.0 * source_size
), t AS (
  SELECT source, source_size, scale, CASE WHEN k0 IS NULL OR k < k0 THEN 2.0 * source_size ELSE level * weight END AS target
  FROM f, l
), h AS (
  SELECT source, size, count(*)::DOUBLE AS n FROM d WHERE size > 0 GROUP BY source, size
), b AS (  -- sum(size * min(2, exp(lam * size / scale))) = target: lam lies between bounds that are halved 90 times
  SELECT source, 0 AS k, -4096.0::DOUBLE AS lo, 4096.0::DOUBLE AS hi FROM t WHERE source_size > 0
  UNION ALL
  SELECT source, k + 1, CASE WHEN taken < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN taken < target THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT b.source, b.k, any_value(b.lo) AS lo, any_value(b.hi) AS hi, any_value(t.target) AS target,
               sum(h.n * h.size * least(2.0, exp(least(100.0, (b.lo + b.hi) / 2 * h.size / t.scale)))) AS taken
        FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source JOIN h ON h.source IS NOT DISTINCT FROM b.source
        WHERE b.k < 90 GROUP BY b.source, b.k)
), y AS (
  SELECT source, round((lo + hi) / 2, 9) AS lam FROM b WHERE k = 90
), r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN d.size = 0 THEN 0.0 WHEN t.target >= 2.0 * t.source_size THEN 2.0
              ELSE round(least(2.0, exp(least(100.0, y.lam * d.size / t.scale))) * 1048576) / 1048576 END AS rate,
         (('0x' || substr(u, 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656 AS v
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
), x AS (
  SELECT *, target - sum(size * floor(rate)) OVER (PARTITION BY source) AS missing,
         sum(CASE WHEN rate > floor(rate) THEN size ELSE 0 END) OVER (
           PARTITION BY source ORDER BY floor(v / (v + rate - floor(rate)) * 281474976710655), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM r
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (floor(rate) + CASE WHEN rate > floor(rate) AND 2 * upto - size <= 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(quality_model.fold() != 0)
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(quality_model.fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_base = sum(not p.weak for p in secret_scan.PARTS)
    shown = lambda spans: F.array_join(  # noqa: E731
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")  # noqa: E731
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(shown(F.filter("spans", lambda s: s["rank"] < n_base)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


#: kind, role, weak, least characters, of which group, what a match must contain, pattern: said again for the SQL, in its own words.
_OP9_PARTS = (
    ("assign", "secret", False, 8, 2, (),
     r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "identifier", False, 16, 0, (), r"AKIA[A-Z0-9]+"),
    ("hex", "secret", False, 32, 0, (), r"[0-9a-f]+"),
    ("login", "identifier", True, 3, 2, (),
     r"""([uU][sS][eE][rR]_?[nN][aA][mM][eE]|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]_?[iI][dD])["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)"""),
    ("opaque", "secret", True, 24, 0, ("[0-9]", "[A-Za-z]"), r"[A-Za-z0-9+/_-]{24,}={0,2}"),
    ("endpoint", "endpoint", True, 1, 0, (),
     r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?"""),
)  # fmt: skip


def _op9_sql(reach: int = 200) -> str:
    quoted = lambda p: p.replace("'", "''")  # noqa: E731
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, '{role}' AS role, {str(weak).lower()} AS weak, {least} AS least,
        regexp_extract_all(text, '{quoted(pattern)}') AS ms, regexp_extract_all(text, '{quoted(pattern)}', {group}) AS vs,
        string_split_regex(text, '{quoted(pattern)}') AS gs, [{", ".join(f"'{x}'" for x in also)}]::VARCHAR[] AS also FROM d"""
        for i, (kind, role, weak, least, group, also, pattern) in enumerate(_OP9_PARTS)
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS ({found}
), m AS (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0
), n AS (
  SELECT doc_id, rank, kind, role, weak, length(ms[i]) AS width, length(vs[i]) >= least AND len(list_filter(also, lambda x: NOT regexp_matches(ms[i], x))) = 0 AS ok,
         CAST(sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop
  FROM m
), s AS (
  SELECT *, stop - width AS start FROM n WHERE ok
), k AS (
  SELECT * FROM s WHERE NOT weak OR EXISTS (
    SELECT 1 FROM s AS o WHERE o.doc_id = s.doc_id AND o.role <> s.role
      AND o.start <= s.stop + {reach} AND s.start <= o.stop + {reach} AND (o.start >= s.stop OR o.stop <= s.start))
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (NOT weak), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Fixed values: the contract's rules, and words that mark a host for the block list.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD_HOST_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    judged = url_filter.judge(pages, rules, url_filter.hosts_with(pages, BAD_HOST_WORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


OP11_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), b AS (
  SELECT DISTINCT host FROM u WHERE len(list_filter(string_split_regex(host, '[.-]'), lambda x: x IN ('adult', 'ads', 'bets', 'casino', 'pills', 'spam'))) > 0
), p AS (
  SELECT DISTINCT host, path FROM u
), f AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.host, p.path
), l AS (
  SELECT h.host, arg_max(b.host, length(b.host)) AS listed
  FROM (SELECT DISTINCT host FROM u) AS h JOIN b ON h.host = b.host OR ends_with(h.host, '.' || b.host) GROUP BY h.host
)
SELECT page_id, u.host, u.path, rule, coalesce(action, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path LEFT JOIN l ON u.host = l.host
"""


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    fixed = chat_repair.repair(rows)
    hashes = chat_repair.digest(fixed.rows).withColumnRenamed("conv_id", "_conv")
    found = fixed.report.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return found.select(*names, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, half a byte at a time; the table of 16 follows from the polynomial."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    halves = f"list_transform(flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c) & 15, ascii(c) >> 4])), lambda h: h::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295)"


OP12_SQL = rf"""
WITH RECURSIVE x AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS m
  FROM conversations
), y AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM x WHERE m <> 0
), o AS (
  SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM y
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS pair
  FROM o
), n AS (
  SELECT conv_id, count(*) AS rows, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM f GROUP BY conv_id
), ins(s, t, said) AS (
  VALUES (0, 0, []), (1, 1, []), (2, 2, []), (3, 3, []), (0, 2, ['user:']), (1, 2, ['user:']), (3, 2, ['user:']), (2, 3, ['assistant:']),
         (0, 3, ['user:', 'assistant:']), (1, 3, ['user:', 'assistant:'])
), step(s, t, want) AS (
  VALUES (0, 1, 'system'), (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')
), dp AS (
  SELECT conv_id, 0 AS pos, 0 AS s, {{'c': 0, 'a': '', 'out': []::VARCHAR[]}} AS v FROM n
  UNION ALL
  SELECT conv_id, pos, s, v FROM (
    SELECT dp.conv_id, f.pos::INT AS pos, e.t AS s,
           min({{'c': dp.v.c + 3 * len(ins.said) + e.c, 'a': dp.v.a || repeat('I', len(ins.said)) || e.a, 'out': dp.v.out || ins.said || e.out}}) AS v
    FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = dp.pos + 1 JOIN ins ON ins.s = dp.s,
    LATERAL (
      SELECT ins.t AS t, 4 AS c, 'D' AS a, []::VARCHAR[] AS out
      UNION ALL
      SELECT step.t, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END + CASE WHEN f.r = left(want, 1) THEN 0 ELSE 3 END,
             CASE WHEN f.r = left(want, 1) THEN 'K' ELSE 'R' END,
             [CASE WHEN f.r = left(want, 1) THEN f.role ELSE want END || ':' || f.text]
      FROM step WHERE step.s = ins.t AND f.fault NOT IN ('b', 'd') AND (want <> 'system' OR f.r = 's')
    ) AS e
    GROUP BY dp.conv_id, f.pos, e.t
  )
), z AS (
  SELECT dp.conv_id, min({{'c': v.c + 3 * len(said), 'a': v.a || repeat('I', len(said)), 'out': v.out || said}}) AS v
  FROM dp JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.pos = n.rows JOIN ins ON ins.s = dp.s
  WHERE ins.t IN (0, 3) GROUP BY dp.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(z.v.c, 0)::BIGINT AS cost, coalesce(z.v.a, '') AS audit,
       sha256(coalesce(array_to_string(z.v.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = found.select("vec_id", "n", "deviation", "identity_error", F.inline("components"))
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_url_filter": op11_url_filter,
    "op12_chat_repair": op12_chat_repair,
    "op13_whitening": op13_whitening,
    "op10_lz_fingerprint": op10_lz_fingerprint,
    "op1_ngram_lm": op1_ngram_lm,
    "op2_warc": op2_warc,
    "op3_chat_format": op3_chat_format,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_model": op7_quality_model,
    "op8_simhash": op8_simhash,
    "op9_secret_scan": op9_secret_scan,
}

ORACLES: dict[str, str] = {
    "op11_url_filter": OP11_SQL,
    "op12_chat_repair": OP12_SQL,
    "op2_warc": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op5_mixing": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_secret_scan": _op9_sql(),
}
