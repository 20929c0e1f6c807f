"""Formatter pipelines: raw histories to aligned histories with a split, each stage written once and counted as it is written.

Rows, interactions and the sum, least and largest of lengths come from an `Observation` on the write itself, so accounting
costs no scan. What has to be distinct (users of raw rows, items) is counted on narrow columns of the written stages.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import sequences as S
from .shared import own_folder
from .splits import exact_shuffle, scale_points

#: Share of users in the test tail of the full mode.
FULL_TEST_RATIO = 0.003


class Stage(NamedTuple):
    name: str
    table: DataFrame
    rows: int
    interactions: int
    shortest: int | None
    longest: int | None


class Formatted(NamedTuple):
    users: DataFrame  # user, history, idx, split
    items: DataFrame
    stages: list[Stage]
    facts: dict[str, int]


def written(histories: DataFrame, name: str) -> Stage:
    """histories as a table of the shared folder, with its counts."""
    seen = Observation(name)
    n = F.size("history")
    counted = histories.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(n).alias("sum"), F.min(n).alias("min"), F.max(n).alias("max"))
    path = own_folder(histories.sparkSession, f"stage-{name}")
    counted.write.parquet(path)
    got = seen.get
    return Stage(name, histories.sparkSession.read.schema(histories.schema).parquet(path), got["rows"], got["sum"] or 0, got["min"], got["max"])


def accounting(stages: list[Stage]) -> DataFrame:
    """stage, place, rows, users, items, interactions, min_length, max_length, mean_length, and what went since the stage before."""
    spark = stages[0].table.sparkSession
    distinct = None
    for k, s in enumerate(stages):
        users = s.table.where("user is not null").select(F.lit(k).alias("place"), F.lit(0).alias("kind"), F.col("user").cast("string").alias("v"))
        items = s.table.select(F.lit(k).alias("place"), F.lit(1).alias("kind"), F.explode(F.transform("history", lambda x: x.cast("string"))).alias("v")).where("v is not null")
        both = users.unionByName(items).distinct()
        distinct = both if distinct is None else distinct.unionByName(both)
    counts = distinct.groupBy("place").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("users"), F.count(F.when(F.col("kind") == 1, 1)).alias("items"))
    kinds = "place int, stage string, rows long, interactions long, min_length int, max_length int, mean_length double, removed_rows long, removed_interactions long"
    rows, last = [], None
    for k, s in enumerate(stages):
        gone = (last.rows - s.rows, last.interactions - s.interactions) if last else (0, 0)
        rows.append((k, s.name, s.rows, s.interactions, s.shortest, s.longest, s.interactions / s.rows if s.rows else None, *gone))
        last = s
    out = spark.createDataFrame(rows, kinds).join(counts, "place", "left")  # one row a stage
    return out.fillna(0, ["users", "items"])


def tail_split(users: DataFrame, total: int, test_ratio: float, percent: float = 100.0) -> DataFrame:
    """users(idx) with split: the tail from int(total (1 - ratio)) is test, the first percent of all (no further than the tail) train."""
    start, limit = scale_points(total, [percent], test_ratio)
    return users.withColumn("split", F.when(F.col("idx") >= start, "test").when(F.col("idx") < limit[percent], "train")).where("split is not null")


def _items_of(histories: DataFrame) -> DataFrame:
    return histories.select(F.explode("history").alias("item")).where("item is not null").distinct()


def _ordered(last: Stage, items: DataFrame, stages: list[Stage], seed, test_ratio: float, percent: float, **facts: int) -> Formatted:
    users = tail_split(exact_shuffle(last.table, "user", seed), last.rows, test_ratio, percent)
    return Formatted(users, items.join(_items_of(last.table), "item", "left_semi"), stages, facts)


def full(raw: DataFrame, captions: DataFrame, complete: DataFrame, longest: int, shortest: int, seed="full", test_ratio: float = FULL_TEST_RATIO) -> Formatted:
    """Full mode: keep captioned items, cut to the latest `longest`; keep items with complete vectors, cut again; keep what
    is left of the caption table, cut again. Users of under `shortest` go at each cut. raw: user (once each), history;
    captions: item (once each) and its columns; complete: item. No n-core. The users are shuffled (splits.exact_shuffle)
    and the tail of test_ratio is the test split.
    """
    stages = [written(raw, "raw")]
    wanted = captions.select("item")
    for name, allowed in (("captions", wanted), ("vectors", complete.select("item")), ("aligned", wanted)):
        stages.append(written(S.length_limits(S.align(stages[-1].table, allowed), longest, shortest), name))
    return _ordered(stages[-1], captions, stages, seed, test_ratio, 100.0)


def small_scale(
    raw: DataFrame, captions: DataFrame, complete: DataFrame, n: int, longest: int, shortest: int, rounds: int | None = 3, seed="scale", test_ratio: float = FULL_TEST_RATIO, percent: float = 100.0
) -> Formatted:
    """Small-scale mode: the n-core with backfill from the captioned items, then again from what of that core has a complete
    vector, then the histories rebuilt over the items found in both. Prefix of `percent` as train, tail as test.

    The fixed-point loop starts from an allowed set, and the second one from what a filter left of the first one's.
    """
    first = written(raw, "raw")
    core = S.n_core_fixpoint(first.table, n, longest, shortest, rounds, allowed=captions, written=True)
    stages = [first, written(core.histories, "captions_core")]
    kept = core.items.join(complete.select("item").join(_items_of(stages[-1].table), "item", "left_semi"), "item", "left_semi")
    again = S.n_core_fixpoint(first.table, n, longest, shortest, rounds, allowed=kept, written=True)
    stages.append(written(again.histories, "vectors_core"))
    final = captions.join(_items_of(stages[-1].table), "item", "left_semi")
    stages.append(written(S.latest_valid(first.table, final, longest, shortest), "aligned"))
    return _ordered(stages[-1], final, stages, seed, test_ratio, percent, core_rounds=core.rounds, vector_rounds=again.rounds)


def latest_rows(raw: DataFrame, items: DataFrame, time: str, ties: list[str], longest: int, shortest: int, seed="full", test_ratio: float = FULL_TEST_RATIO) -> Formatted:
    """Full mode for logs with several rows a user: known items and the latest `longest` of each row, then each user's
    latest row, then the length limit. raw: user, history, time and ties. A row of which no item is known counts as an
    empty one until its user has another. Each stage's rows, users and interactions are kept.
    """
    stages = [written(raw.withColumn("row_", F.monotonically_increasing_id()), "raw")]
    now = stages[-1].table
    kept = S.align(now.select("row_", "history"), items, "row_").withColumnRenamed("history", "h_")
    empty = F.array().cast(dict(raw.dtypes)["history"])
    aligned = now.drop("history").join(kept, "row_", "left").withColumn("history", S.tail(F.coalesce("h_", empty), longest)).select("row_", *raw.columns)
    stages.append(written(aligned, "known_items"))
    stages.append(written(S.latest_per_user(stages[-1].table, "user", time, *ties), "latest_row"))
    stages.append(written(stages[-1].table.where(F.size("history") >= shortest), "long_enough"))
    return _ordered(stages[-1], S.keep_first(items, "item", "item"), stages, seed, test_ratio, 100.0)
