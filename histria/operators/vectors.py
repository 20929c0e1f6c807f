"""Vectors as ARRAY<FLOAT>: normalising, exact neighbours, neighbour stability, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    """In DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x.cast("double") / n)


def is_complete(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mean_pool(nested: Column) -> Column:
    """Null rows left out, then: rows of equal length give their mean, others all their numbers one after the other; null
    where no row or no number is left."""
    rows = F.filter(nested, lambda r: r.isNotNull())
    n, first = F.size(rows), F.transform(F.get(rows, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(rows, 2, F.greatest(n, F.lit(1))), first, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    even = F.forall(rows, lambda r: F.size(r) == F.size(first))
    flat = F.filter(F.transform(F.flatten(rows), lambda x: x.cast("double")), lambda x: x.isNotNull())
    pooled = F.when(even, F.transform(total, lambda x: x / n)).otherwise(flat)
    return F.when((n > 0) & (F.size(pooled) > 0), pooled)


def pool_tokens(hidden: Column, mask: Column, how: str = "mean") -> Column:
    """A text's vector from its tokens' states (array of arrays) and attention mask (array of 0 and 1): `mean` over the
    unmasked tokens, `cls` the first token, `last` the unmasked count's token (the first if all are masked). Null where
    there is no token, or for mean no unmasked one."""
    if how == "cls":
        return F.get(hidden, F.lit(0))
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    if how == "last":
        return F.get(hidden, F.greatest(n - 1, F.lit(0)))
    if how != "mean":
        raise ValueError(how)
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    kept = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m))
    total = F.aggregate(kept, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def neighbor_overlap(reference: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """anchor, overlap: shared neighbours / k (k even where lists are shorter), for anchors of both."""
    both = reference.select("anchor").distinct().join(target.select("anchor").distinct(), "anchor")
    shared = reference.select("anchor", "item").join(target.select("anchor", "item"), ["anchor", "item"]).groupBy("anchor").agg(F.count("*").alias("s"))
    return both.join(shared, "anchor", "left").select("anchor", (F.coalesce("s", F.lit(0)) / F.lit(k)).alias("overlap"))


def rank_ndcg(reference: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """anchor, ndcg of the target's list, where the reference's rank r (from 1) has relevance k - r + 1; anchors missing from target are skipped."""
    ref = reference.where(F.col("rank") <= k).select("anchor", "item", (F.lit(k) - F.col("rank") + 1).cast("double").alias("rel"), "rank")
    ideal = ref.groupBy("anchor").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("ideal"))
    got = target.where(F.col("rank") <= k).join(ref.select("anchor", "item", "rel"), ["anchor", "item"], "left")
    dcg = got.groupBy("anchor").agg(F.sum(F.coalesce("rel", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    return ideal.join(dcg, "anchor").select("anchor", F.coalesce(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def neighbor_retention(reference: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """anchor, retention: neighbours that are candidates / k."""
    kept = reference.join(candidates.select("item").distinct(), "item", "left_semi").groupBy("anchor").agg(F.count("*").alias("s"))
    return reference.select("anchor").distinct().join(kept, "anchor", "left").select("anchor", (F.coalesce("s", F.lit(0)) / F.lit(k)).alias("retention"))


def fuse(sources: list[tuple[DataFrame, float]], normalize: bool = True, normalize_output: bool = True) -> DataFrame:
    """item, v: vectors of all sources for items in all of them, each L2-normalised and scaled by sqrt(w / sum w), one after the other."""
    total = sum(w for _, w in sources)
    out = None
    for i, (df, w) in enumerate(sources):
        v = l2_normalize(F.col("v")) if normalize else F.transform("v", lambda x: x.cast("double"))
        scale = F.lit((w / total) ** 0.5)
        one = df.select("item", F.transform(v, lambda x: x * scale).alias(f"v{i}"))  # noqa: B023
        out = one if out is None else out.join(one, "item")
    v = F.concat(*[F.col(f"v{i}") for i in range(len(sources))])
    return out.select("item", (l2_normalize(v) if normalize_output else v).alias("v"))


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """pearson, NaN where a side is constant."""
    one = rows.agg(F.corr(x, y).alias("c"), (F.min(x) == F.max(x)).alias("cx"), (F.min(y) == F.max(y)).alias("cy"))
    return one.select(F.when(F.col("cx") | F.col("cy"), F.lit(float("nan"))).otherwise(F.col("c")).alias("pearson"))
