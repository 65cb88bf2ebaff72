from textloom.llm.quality_rules import apply_rules


def brute(text):
    import re

    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b c", "a b c a b c", "x y z x y z x y z", "the\nthe\n\nthe ### $",
             "a a a a a a", "é ü 😀 b\x85c d", "und und " * 40, "w1 w2 w3 w4 w1 w2 w3 q w1 w2 w3 w4\r\n", "l\n" * 9]
    rows = [(i, t, 7, 1) for i, t in enumerate(texts)] + [(1, "", 7, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _words int")
    got = apply_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r


def test_empty_table_and_verdict(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert apply_rules(df).count() == 0
    good = "the cat sat on a mat and it was warm " * 1 + " ".join(f"the w{i}" for i in range(60))
    bad = " ".join(f"w{i}***" for i in range(90))
    got = [r.kept for r in apply_rules(spark.createDataFrame([(1, good), (2, bad)], df.schema)).orderBy("doc_id").collect()]
    assert got == [True, False]
