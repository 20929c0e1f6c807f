"""Ranks, running totals and percentiles over all rows in two levels: range buckets, then windows inside each.

No task holds more than a bucket. Bounds come from a bounded sample of the keys; they decide balance, never results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

BUCKETS = 256
#: Keys looked at for the bounds.
SAMPLE = 8192


def bounds(rows: DataFrame, key: str, buckets: int = BUCKETS, sample: int = SAMPLE) -> list:
    """At most buckets - 1 ascending values of key, about equally many rows apart."""
    some = rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(sample)
    values = sorted(r[0] for r in some.collect() if r[0] == r[0])
    step = max(1, math.ceil(len(values) / buckets), min(32, len(values) // 8))  # few rows need few buckets
    return sorted(set(values[step::step]))


def bucket_of(key: str, cuts: list) -> Column:
    """Number of cuts below the key by binary search; -1 for null."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) <= F.lit(cuts[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))


def running(rows: DataFrame, order: list[str], weight: str | None = None, out: str = "before", descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """rows with `out`: the weights' sum (without weight: the number) of the rows before each in the order.

    As running_sums()."""
    return running_sums(rows, order, {out: weight}, descending, buckets)


def running_sums(rows: DataFrame, order: list[str], weights: dict[str, str | None], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """rows with each of the names: the sum of its weight (None: the number) over the rows before each in the order.

    The first order column should tell most rows apart: rows equal in it share a bucket. descending turns that column
    round. Nulls come first, or last if descending, as in Spark's own order."""
    first = order[0]
    kept = saved(rows)
    w = {out: F.col(weight) if weight else F.lit(1) for out, weight in weights.items()}
    dealt = kept.withColumn("b_", bucket_of(first, bounds(kept, first, buckets)))
    turn = F.desc if descending else F.asc
    per = dealt.groupBy("b_").agg(*[F.sum(x).alias(f"w{i}_") for i, x in enumerate(w.values())])  # at most buckets + 1 rows
    upto = Window.orderBy(turn("b_")).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("b_", *[F.coalesce(F.sum(f"w{i}_").over(upto), F.lit(0)).alias(f"base{i}_") for i in range(len(w))])
    inside = Window.partitionBy("b_").orderBy(turn(first), *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sums = {out: F.col(f"base{i}_") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for i, (out, x) in enumerate(w.items())}
    return dealt.join(F.broadcast(base), "b_").withColumns(sums).drop("b_", *[f"base{i}_" for i in range(len(w))])


def percentiles(rows: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row, one column `p`: linear-interpolated percentiles (null without values), by rank selection on the distinct values."""
    by = rows.select(value.cast("double").alias("v_")).where("v_ is not null").groupBy("v_").agg(F.count("*").alias("m_"))
    placed = running(by, ["v_"], "m_", "lo_")
    total = placed.agg(F.coalesce(F.sum("m_"), F.lit(0)).alias("n_"))
    x = placed.crossJoin(F.broadcast(total))  # one row of totals
    holds = lambda rank: (F.col("lo_") <= rank) & (rank < F.col("lo_") + F.col("m_"))
    picks, found = [], []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("n_") - 1)
        picks += [F.max(F.when(holds(F.floor(at)), F.col("v_"))).alias(f"a{i}"), F.max(F.when(holds(F.ceil(at)), F.col("v_"))).alias(f"z{i}"), F.max(at - F.floor(at)).alias(f"f{i}")]
        found.append(F.col(f"a{i}") + (F.col(f"z{i}") - F.col(f"a{i}")) * F.col(f"f{i}"))
    return x.agg(*picks).select(F.array(*found).alias("p"))
