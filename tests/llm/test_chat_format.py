from pyspark.sql import functions as F

from textloom.llm.chat_format import format_chats, loss_text, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_of_hostile_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<<s>>", "a\\", None, "", "<", "</", "<sep>", "<\\\\/s>\n", "<<SYS>>x<</SYS>>",
             "</s></s>", "é😀\n\n", "[INST", "x" * 70000]
    rows = [(1, i, "user" if i % 3 else "assistant", t, "?") for i, t in enumerate(texts)]
    rows += [(2, 0, None, "a", "?"), (2, 0, None, "a", "?"), (2, None, "odd\\n\nrole</s>", "b", "?"), (None, 5, "assistant", "c", "?")]
    got = format_chats(spark.createDataFrame(rows, SCHEMA)).select(
        "conv_id", "formatted", read_chats(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    by = {r.conv_id: r for r in got.collect()}
    assert [(t.role, t.text) for t in by[1].turns] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert by[1].loss == "".join(r[3] or "" for r in rows[: len(texts)] if r[2] == "assistant")
    assert [(t.role, t.text) for t in by[2].turns] == [("odd\\n\nrole</s>", "b"), ("", "a"), ("", "a")]
    assert by[2].formatted.count("</s>") == 2 and by[2].formatted.count("<sep>") == 1
    assert by[None].loss == "c"
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
