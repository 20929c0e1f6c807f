import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histria.llm import chat

PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", " ", "\n", "a", "é", "%0A", "%", "[INST] ", " [/INST]</s>", "<s>[INST] user\n", "𝄞"]), max_size=7).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\n role</s>"]), PIECES), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    f = chat.parse_chat(chat.format_chat(df)).withColumn("loss", F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")).first()
    assert [(x["role"], x["text"]) for x in f["turns"]] == turns
    assert f["loss"] == "".join(t for r, t in turns if r == "assistant")


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b"), (1, 1, "assistant", "see </s> now")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).first()["formatted"] == "<s>[INST] user\na \\ b [/INST]</s><s>[INST] assistant\nsee \\</s> now [/INST]</s>"


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, 1, "user", "x", 0), (2, None, None, None, 0), (2, 1, "user", "b", 0), (2, 1, "user", "a", 0), (2, 1, "user", "a", 0), (3, 1, "assistant", "", 0), (4, 0, "user", "y" * 300_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chat(chat.format_chat(df)).collect()}
    assert got == {None: [("user", "x")], 2: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], 3: [("assistant", "")], 4: [("user", "y" * 300_000)]}
    assert chat.format_chat(df.where("false")).count() == 0


def test_digest_of_turns(spark, tmp_path):
    df = spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest() and got[7]["loss_chars"] == 2
    trap = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(trap.encode()).hexdigest()
