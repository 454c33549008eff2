"""Chat formatting: exact way back, placeholders, attachments and loss mask."""

import hashlib

import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import chat

ODD = ["", "[", "[IN", "ST]", "\\", "[\\INST]", "[\\\\/INST]", "a</s", ">", "<", "</s>[INST] ok [/INST]", "[+]", "[IMG]", "[[IMG]", "é\n", "[ROLE]x[SEP]", "<s>", "[/ROLE]"]


def part(kind="text", text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, uri, width, height, seconds, pages)


def told(spark, rows):
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    df = df.withColumns({c: F.lit(1) for c in ("segments", "message", "messages", "formatted", "attachments", "loss", "text")}).repartition(3)
    out = chat.format_conversations(df)
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    return {r.conv_id: r for r in read.collect()}


def test_every_text_and_role_comes_back(spark):
    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.tuples(
        st.sampled_from(["user", "assistant", "system", "tool", "", None, "[SEP]"]),
        st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), min_size=1, max_size=4)), min_size=1, max_size=12))
    def holds(messages):
        messages = [(role, ["".join(c for c in t if not "\ud800" <= c <= "\udfff") for t in texts]) for role, texts in messages]
        row = told(spark, [(1, i, role, [part(text=t) for t in texts]) for i, (role, texts) in enumerate(messages)])[1]
        assert [(t.role, t.text) for t in row.turns] == [(role or "", "".join(texts)) for role, texts in messages]
        assert row.trained == "".join("".join(texts) for role, texts in messages if role == "assistant")
        assert row.formatted == "".join(s.text for s in row.segments)

    holds()


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [part(text="see"), part("image", uri="a.png", width=33, height=16), part("document", uri="b.pdf", pages=3), part(text="and"), part(text="hear")]),
        (1, 1, "user", [part("audio", uri="c.wav", seconds=2.0)]),
        (1, 2, "assistant", [part(text="ok"), part("image", uri="d.png"), part("video", text="odd kind"), part(None, text="no kind")]),
        (2, None, None, None), (2, 0, "user", []), (None, 0, "user", [part()]), (None, 0, "user", [part()])]
    out = told(spark, rows)
    assert out[1].formatted == "<s>[INST]see[IMG][DOC]and[+]hear[/INST][INST][AUD][/INST][OUT]ok[IMG]odd kind[+]no kind</s>"
    assert [tuple(a) for a in out[1].attachments] == [(0, "image", "a.png", 3), (0, "document", "b.pdf", 768), (1, "audio", "c.wav", 25), (2, "image", "d.png", 1)]
    assert out[1].n_expanded == 797 and out[1].trained == "okodd kindno kind"
    assert [(t.role, t.text, t.media) for t in out[1].turns] == [
        ("user", "seeandhear", ["image", "document"]), ("user", "", ["audio"]), ("assistant", "okodd kindno kind", ["image"])]
    assert [(t.role, t.text) for t in out[2].turns] == [("", ""), ("user", "")] and out[2].attachments == []
    assert len(out[None].turns) == 2


def test_ties_long_texts_and_empty_tables(spark):
    long = "word [INST] " * 30_000
    out = told(spark, [(1, 0, "user", [part(text=t)]) for t in ("b", "a", "b", long)] + [(2, i, "user", [part(text=str(i))]) for i in range(300)])
    assert sorted(t.text for t in out[1].turns) == sorted(["b", "a", "b", long])
    assert [t.text for t in out[2].turns] == [str(i) for i in range(300)]
    none = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.format_conversations(none).count() == 0


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "[\\INST] é"), (1, 2, "assistant", "</s>"), (5, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op11_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].loss_sha256 == digest("[\\INST] é</s>") and got[1].loss_chars == 13 and got[1].n_turns == 3
    assert got[1].turns_sha256 == digest("user\n\nassistant\n[\\INST] é\nassistant\n</s>\n")
    assert got[5].loss_sha256 == digest("") and got[5].formatted_chars == len("<s>[OUT]</s>")
    assert got[-1].loss_sha256 == digest(chat.PROBE) and got[-1].n_turns == 2


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_equals_its_check(spark, sf):
    assert difference(spark, connect(sf), "op11", chat.op11_chat_format, chat.OP11_SQL, sf) is None


def test_main_path_runs_no_python(spark):
    plan = chat.op11_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
