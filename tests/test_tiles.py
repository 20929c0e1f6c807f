"""What tiles of pairs compute without a row a pair, and how far vectors are copied."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from histria import plans
from histria.operators import blocks, cooccurrence
from histria.operators import ranking as R

from .compare import DATA, assert_same, has_data

needs_data = pytest.mark.skipif(not has_data(), reason="no test tables")


def made(name, spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(blocks, "pairs", none)
    assert_same(plans.QUERIES[name](spark, DATA), plans.ORACLES[name])


@needs_data
def test_candidate_zscore_makes_its_rows_in_tiles(spark, monkeypatch):
    made("candidate_zscore", spark, monkeypatch)


@needs_data
def test_fused_ranking_sums_in_tiles(spark, monkeypatch):
    made("fused_ranking", spark, monkeypatch)


@needs_data
def test_multi_list_fusion_makes_its_rows_in_tiles(spark, monkeypatch):
    made("multi_list_fusion", spark, monkeypatch)


@pytest.mark.parametrize("size", [9, 500])
def test_spread_over_tiles_is_that_of_the_pairs(spark, size):
    """With a list that is empty for some anchors, one far from 0 that hardly differs, and a vector of NaN."""
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.normal(size=3).round(2)] for _ in range(60)]
    v[13][0] = float("nan")
    df = spark.createDataFrame(list(enumerate(v)), "item long, v array<double>")
    a = df.where("item % 7 = 0")
    at = {"x": F.when(F.expr("item % 3 = 0 AND anchor % 14 = 0"), F.col("score")), "y": F.when(F.col("item") != 13, 1e6 + 0.0 * F.col("score")), "z": F.col("score")}
    want = {r["anchor"]: r for r in R.spread(blocks.pairs(a, df, 6), at, "anchor").collect()}

    def lists(t):
        return {"x": (t.pair & (t.items % 3 == 0) & (t.ids[:, None] % 14 == 0), t.score), "y": (t.pair & (t.items != 13), 1e6 + 0 * t.score), "z": (t.pair, t.score)}

    got = {r["item"]: r for r in blocks.pair_spread(a, df, lists, ["x", "y", "z"], 6, size).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for i, r in got.items():
        for c in r.asDict():
            if c != "item":
                assert (r[c] is None) == (want[i][c] is None), c
                assert r[c] is None or r[c] == pytest.approx(want[i][c], abs=1e-9, nan_ok=True), c


def test_tiles_round_half_away_from_zero():
    assert R.tile_round(1)(np.array([0.25, -0.25, 0.35, -0.05, 0.04, np.nan])).tolist()[:5] == [0.3, -0.3, 0.4, -0.1, 0.0]


def test_vectors_are_sent_once_a_shelf(spark, monkeypatch):
    """Far fewer rows meet than pairs of an anchor and a block, where no bound rules a block out; neighbours are the same."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)).round(2)
    x[100:160] = x[5]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "item long, v array<float>")
    x, sent, met = x.astype(np.float32).astype(float), [], blocks._met
    monkeypatch.setattr(blocks, "TILES", 1)
    monkeypatch.setattr(blocks, "_met", lambda pairs, *more: (sent.append(pairs.count()), met(pairs, *more))[1])
    got = blocks.neighbors(df, df, 7, 6, 10)
    s = (x @ x.T).round(6)
    want = {(i, r + 1): j for i in range(500) for r, j in enumerate(sorted((j for j in range(500) if j != i), key=lambda j: (-s[i, j], j))[:7])}
    assert {(r["anchor"], r["rank"]): r["item"] for r in got.rows.collect()} == want
    assert sum(sent) < got.met / 3


def test_pairs_of_a_left_item_lie_in_one_task(spark):
    """So that all but the best of them drop out before a shuffle by the item."""
    long = spark.range(3000).select((F.col("id") / 50).cast("int").alias("user"), (F.col("id") % 50).alias("pos"), (F.col("id") * 7 % 31).alias("item"))
    counts = long.groupBy("item").agg(F.count("*").alias("cnt"))
    got = cooccurrence.window_ppmi(long, counts, 5, 1, parts=8, by=1)
    assert got.withColumn("t", F.spark_partition_id()).groupBy("left").agg(F.count_distinct("t").alias("n")).where("n > 1").count() == 0
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in cooccurrence.window_ppmi(long, counts, 5, 1).collect()}


def test_retrieval_of_few_items(spark):
    rel = spark.createDataFrame([(a, i, float((a * i) % 7)) for a in range(6) for i in range(12) if a != i], "anchor int, item int, rel double")
    few = spark.createDataFrame([(1,), (4,), (50,)], "item int")
    near = rel.select("anchor").distinct().crossJoin(few).where("anchor <> item").withColumn("rank", (F.col("item") % 5 + 1))
    cut = cooccurrence.retrieval(near, rel, 5, few)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, cooccurrence.retrieval(near, rel, 5).collect())) and cut.count() == 6
