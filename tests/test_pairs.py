"""Tables of all pairs: only vectors are shuffled, pairs are neither written nor dealt."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from histria import plans
from histria.operators import blocks
from histria.operators import ranking as R
from tests.test_oracle import DATA


def test_pairs_over_tiles(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 5)).round(2)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 4) for i in range(70)], "item long, v array<float>, label int")
    got = blocks.pairs(df.where("item % 7 = 0").withColumnRenamed("label", "la"), df, 6, size=9).collect()
    v = v.astype(np.float32).astype(float)
    assert {(r["anchor"], r["item"], r["la"], r["label"]) for r in got} == {(a, b, a % 4, b % 4) for a in range(0, 70, 7) for b in range(70) if a != b} and len(got) == 690
    assert all(abs(r["score"] - v[r["anchor"]] @ v[r["item"]]) < 1e-6 for r in got)
    assert blocks.pairs(df.limit(0), df, 6).count() == 0 == blocks.pairs(df, df.limit(0), 6).count()


def test_wide_fusions_are_the_long_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(s, u, round(float(rng.normal()), 3) if u % 3 and s else None, round(float(rng.normal()), 3) if u % 2 and s != 1 else None) for s in range(4) for u in range(20)]
    t = spark.createDataFrame(rows, "sample int, uid long, x double, y double").where("x is not null or y is not null")
    cols = {"us": F.col("x"), "ss": F.col("y")}
    wide = t.join(R.spread(t, cols), "sample")
    x, y = (t.where(f"{c} is not null").select("sample", "uid", F.col(c).alias("score")) for c in "xy")
    freq = t.select("uid", (F.col("uid") % 9).alias("freq")).distinct()
    for how in ("z", "minmax"):
        want = {(r["sample"], r["uid"]): (r["score"], r["gate"]) for r in R.fuse_two(x, y, freq, how).collect()}
        score, gate = R.fused_two(F.col("x"), F.col("y"), F.col("uid") % 9, how)
        got = {(r["sample"], r["uid"]): (r["score"], r["gate"]) for r in wide.select("sample", "uid", score.alias("score"), gate.alias("gate")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        lists = x.withColumn("list", F.lit(0)).unionByName(y.withColumn("list", F.lit(1)))
        want = {(r["sample"], r["uid"]): r["score"] for r in R.fuse_lists(lists, how).collect()}
        got = {(r["sample"], r["uid"]): r["score"] for r in wide.select("sample", "uid", R.fused_lists(cols, how).alias("score")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["candidate_zscore", "fused_ranking", "multi_list_fusion", "pair_pearson"])
def test_pairs_go_through_no_exchange(spark, name):
    """A pair lies above the tiles' cogroup; what follows it takes partial sums before any exchange, windows and joins of pairs are gone."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert not re.search(r"Window|Join", above)
    assert "Exchange" not in above or "partial_" in above[above.index("Exchange") :]


def test_short_table_for_fusion_is_bounded(spark):
    from histria.plans import analytics

    t = analytics._short_table(spark, DATA, 12)
    assert t.groupBy("sample").count().agg(F.max("count")).first()[0] <= 60
