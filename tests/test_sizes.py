"""Tasks whose rows follow ROWS and PAIRS, not the session's shuffle partitions; with the same results."""

import statistics

import pytest
from pyspark.sql import functions as F

from histria import plans
from histria.operators import catalog, cooccurrence, report, shared
from histria.sources import driver

from .compare import DATA, assert_same, has_data

needs_data = pytest.mark.skipif(not has_data(), reason="no test tables")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 500)
    monkeypatch.setattr(driver, "PAIRS", 2500)


def largest(df):
    """Rows of the largest task."""
    return df.groupBy(F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0]


@needs_data
def test_tasks_of_the_log_are_bounded(spark, small):
    rows = driver.read(spark, DATA, "lineitem").count()
    assert rows > 5000
    assert largest(driver.interactions(spark, DATA)) < rows / 4
    assert largest(driver.histories(spark, DATA).select(F.explode("history"))) < rows / 4
    assert largest(plans.QUERIES["cooccurrence_pairs"](spark, DATA)) < 5 * rows / 6


@needs_data
@pytest.mark.parametrize("name", ["usable_history", "cooccurrence_pairs", "ncore_backfill", "union_splits", "ppmi", "negative_pair_sample", "user_histories"])
def test_dealt_query_equals_sql(spark, small, name):
    assert_same(plans.QUERIES[name](spark, DATA), plans.ORACLES[name])


def test_a_frequent_pair_is_counted_where_it_is_made(spark):
    long = spark.range(40_000).select(F.lit(1).alias("user"), F.col("id").alias("pos"), (F.col("id") % 2).alias("item"))
    assert [tuple(r) for r in cooccurrence.window_pairs(long, 1, parts=8).collect()] == [(0, 1, 2 * 39_999)]


def test_few_rows_are_left_to_the_session(spark):
    assert shared.parts(spark, shared.FEWEST * shared.ROWS) is None
    assert shared.parts(spark, 100 * shared.ROWS + 1) == 101


def test_experiment_pairs_in_tiles(spark, monkeypatch):
    """One key holds most pairs: they lie in many tasks, and no pair is lost or repeated."""
    kind = F.when(F.col("id") % 3 == 0, "uid").otherwise("sid")
    e = spark.range(900).select(F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") < 6, "few").otherwise("d").alias("data"), F.lit("m").alias("model"), F.lit("s").alias("source"), kind.alias("repr_type"))
    want = sorted(map(tuple, catalog.experiment_pairs(e).select("uid_name", "sid_name").collect()))
    assert len(want) == len(set(want)) == 2 * 4 + 298 * 596
    monkeypatch.setattr(catalog, "SIDE", 32)
    monkeypatch.setattr(catalog, "PAIRS", 10_000)
    got = catalog.experiment_pairs(e)
    assert sorted(map(tuple, got.select("uid_name", "sid_name").collect())) == want
    assert largest(got) < len(want) / 4


def test_score_summary_with_ties_nulls_and_one_side(spark):
    rows = [(0.5, True), (0.5, False), (1.0, True), (2.0, True), (0.0, False), (0.25, False), (None, True), (None, False), (0.5, True)]
    got = cooccurrence.score_summary(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()
    for y, side in ((True, "positive"), (False, "negative")):
        mine = [s for s, z in rows if z == y and s is not None]
        assert (got[f"n_{side}"], got[f"mean_{side}"], got[f"median_{side}"]) == (len(mine), pytest.approx(statistics.mean(mine)), statistics.median(mine))
    key = lambda s: float("-inf") if s is None else s
    met = [(key(a) > key(b)) + 0.5 * (key(a) == key(b)) for a, y in rows if y for b, z in rows if not z]
    assert got["auc"] == pytest.approx(sum(met) / len(met))
    one = cooccurrence.score_summary(spark.createDataFrame(rows[:1], "s double, y boolean"), "s", F.col("y")).first()
    assert (one["n_positive"], one["n_negative"], one["median_positive"], one["mean_negative"], one["median_negative"], one["auc"]) == (1, 0, 0.5, None, None, None)
    none = cooccurrence.score_summary(spark.createDataFrame([], "s double, y boolean"), "s", F.col("y")).first()
    assert (none["n_positive"], none["n_negative"], none["median_positive"], none["auc"]) == (0, 0, None, None)


@needs_data
def test_spaces_do_not_ask_for_the_local_log(spark):
    from histria.plans.report import _report

    r = _report(spark, DATA)
    assert r.spaces.count() == len(report.SPACES)
    assert "own" not in r.__dict__ and "scores" in r.__dict__
