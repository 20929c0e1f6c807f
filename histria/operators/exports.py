"""Comparison of several code exports of the same vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes as C
from . import cooccurrence as O
from . import vectors as V
from .blocks import exact_neighbors
from .shared import saved
from .splits import hash_sample, random_pairs


def compare_exports(source: DataFrame, exports: dict[str, tuple[DataFrame, DataFrame]], pairs: int = 100_000, subset: int = 1024, ks: tuple[int, ...] = (20, 50), seed=42, digits: int = 6) -> DataFrame:
    """One row an export: items, code quality, and how it keeps the source's geometry.

    source: item, v. exports: name -> (item, codes; item, v as the codes give it back). Only items of all tables count. The
    cosines of `pairs` random pairs are correlated by value and by rank; for `subset` items the nearest k among them by the
    source are sought among the nearest k by the export."""
    common = source.select("item")
    for codes, back in exports.values():
        common = common.join(codes.select("item"), "item", "left_semi").join(back.select("item"), "item", "left_semi")
    common = saved(common)
    unit = lambda t: saved(t.join(common, "item", "left_semi").select("item", V.l2_normalize(F.col("v")).alias("v")))
    drawn = saved(random_pairs(common, "item", pairs, seed))
    few = saved(hash_sample(common, "item", subset, seed))

    def cosines(t: DataFrame, name: str) -> DataFrame:
        left, right = t.select(F.col("item").alias("a"), F.col("v").alias("x")), t.select(F.col("item").alias("b"), F.col("v").alias("y"))
        return drawn.join(left, "a").join(right, "b").select("id", F.round(V.dot(F.col("x"), F.col("y")), digits).alias(name))

    def nearest(t: DataFrame) -> DataFrame:
        mine = t.join(few, "item", "left_semi")
        return saved(exact_neighbors(mine, mine, max(ks), digits))

    base = unit(source)
    base_cosines, base_nearest = saved(cosines(base, "s")), nearest(base)
    out = None
    for name, (codes, back) in exports.items():
        own, table = codes.join(common, "item", "left_semi"), unit(back)
        both = saved(base_cosines.join(cosines(table, "e"), "id"))
        by_rank = O.average_rank(O.average_rank(both, "s", "rs"), "e", "re")
        found = nearest(table)
        one = C.collision_stats(own).withColumnRenamed("items", "item_count")
        one = one.crossJoin(C.slot_quality(own).agg(F.avg("entropy").alias("slot_entropy"), F.avg("dead").alias("dead_ratio"), F.count("*").alias("slots")))
        one = one.crossJoin(V.correlation(both, "s", "e").toDF("pearson")).crossJoin(V.correlation(by_rank, "rs", "re").toDF("spearman"))
        for k in ks:
            one = one.crossJoin(V.neighbor_overlap(base_nearest.where(F.col("rank") <= k), found.where(F.col("rank") <= k), k).agg(F.avg("overlap").alias(f"recall_{k}")))
        one = one.withColumn("method", F.lit(name))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
