import pytest

from pyspark.sql import functions as F

from histria import specs
from histria.operators import codes, splits, vocab


def test_markers():
    assert list(vocab.marker_tokens(["sid", "uid", "text"], ["sid"]).items()) == [("sid", "<repr:sid>"), ("uid", "<repr:uid>"), ("text", "<repr:text>")]
    assert vocab.marker_tokens(["a", "b"], ["a", "b"])["decoder_a_b"] == "<repr:decoder_a_b>"
    assert vocab.marker_tokens(["uid"], ["uid", "sid"], graph=False) == {"uid": "<uid>", "sid": "<sid>"}


def test_slot_ranges_hold_all_tokens_of_the_view(spark):
    df = spark.createDataFrame([(i, [i % 4, i % 3]) for i in range(40)], "item long, codes array<int>")
    ranges = {r["slot"]: (r["first"], r["last"]) for r in vocab.slot_ranges(df, 2, 8).collect()}
    assert ranges == {0: (0, 7), 1: (8, 15), 2: (16, 19)}  # 12 codes, up to four items each
    for r in codes.sid_view(df, 2, 8).collect():
        assert all(ranges[s][0] <= t <= ranges[s][1] for s, t in enumerate(r["value"]))
    assert vocab.slot_codes(vocab.slot_ranges(df, 2, 8)).count() == 20
    assert vocab.slot_codes(vocab.slot_ranges(df.limit(0), 2, 8)).where("slot = 2").count() == 0


def test_fusion_spec():
    got = specs.fusion_spec({"sources": ["Llama3.1", {"model": "w2v", "weight": 0, "config": {"seed": 1, "dims": 8}}], "normalize_output": True})
    assert got["sources"][0] == {"model": "llama31", "normalize": True, "reduce_dim": 0, "weight": 1.0}
    assert got["sources"][1]["config"] == {"dims": 8} and got["normalize_output"]
    assert specs.fusion_spec(model="Bert")["sources"] == [{"model": "bert", "normalize": False, "reduce_dim": 0, "weight": 1.0}]
    for bad in ({}, {"sources": [{"weight": 1}]}, {"sources": [{"model": "a", "weight": 0}]}, {"sources": [{"model": "a", "weight": -1}, "b"]}, {"sources": [{"model": "a", "reduce_dim": -2}]}, {"sources": ["a"], "fusion": "sum"}):
        with pytest.raises(ValueError):
            specs.fusion_spec(bad)


def test_policies_are_checked(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user string")
    for policy in ("other", "official"):
        with pytest.raises(ValueError):
            splits.public_sets(users, policy, 1)
    got = splits.public_sets(users, "ratio", 1, official=spark.createDataFrame([("z",)], "user string"), ratio=0.5).collect()
    assert sorted(r["split"] for r in got) == ["finetune", "test", "valid"]


def test_policies_share_one_order(spark):
    """with the order given no shuffle is drawn again, and the sets are the same."""
    users = spark.range(40).select(F.col("id").cast("string").alias("user"))
    ordered = splits.exact_shuffle(users, "user", 1)
    want = {tuple(r) for r in splits.public_sets(users, "ratio", 1).select("user", "split").collect()}
    real = splits.exact_shuffle
    splits.exact_shuffle = None
    try:
        got = {tuple(r) for r in splits.public_sets(users, "ratio", 1, ordered=ordered).select("user", "split").collect()}
    finally:
        splits.exact_shuffle = real
    assert got == want
