"""Item frequencies, frequency buckets, ranking breakdowns and quality splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def item_frequency(histories: DataFrame, shortest: int = 1) -> DataFrame:
    """item, freq over histories of at least `shortest` elements."""
    return histories.where(F.size("history") >= shortest).select(F.explode("history").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))


def target_frequency(histories: DataFrame) -> DataFrame:
    """item, freq as a supervised target: every position but the first of each history."""
    return histories.select(F.posexplode("history").alias("pos", "item")).where("pos > 0").groupBy("item").agg(F.count("*").alias("freq"))


def bucket_labels(boundaries: list[int]) -> list[tuple[str, int, int | None]]:
    """(label, low, high): `0`, `1-5`, ... and an open last one `101+`, from boundaries that start at 0."""
    b = sorted(set(boundaries))
    if not b or b[0] != 0:
        raise ValueError("boundaries start with 0")
    out: list[tuple[str, int, int | None]] = [("0", 0, 0)]
    for low, high in zip(b, b[1:]):
        out.append((f"{low + 1}-{high}", low + 1, high))
    return [*out, (f"{b[-1] + 1}+", b[-1] + 1, None)]


def frequency_bucket(freq: Column, boundaries: list[int]) -> Column:
    out = None
    for label, _, high in bucket_labels(boundaries):
        if high is None:
            return out.otherwise(label) if out is not None else F.lit(label)
        out = F.when(freq <= high, label) if out is None else out.when(freq <= high, label)
    return out


def bucket_table(spark: SparkSession, boundaries: list[int]) -> DataFrame:
    rows = [(i, label, low, high) for i, (label, low, high) in enumerate(bucket_labels(boundaries))]
    return spark.createDataFrame(rows, "bucket_index int, frequency_bucket string, low long, high long")


def rank_metrics(rank: Column, k: int) -> tuple[Column, Column, Column]:
    """(hit, ndcg, reciprocal rank): a null rank is a miss, the reciprocal rank knows no cut-off."""
    inside = rank.isNotNull() & (rank <= k)
    return F.when(inside, 1.0).otherwise(0.0), F.when(inside, 1 / F.log2(rank + 1.0)).otherwise(0.0), F.when(rank.isNotNull(), 1.0 / rank).otherwise(0.0)


def breakdown(records: DataFrame, freq: DataFrame, boundaries: list[int], ks: list[int]) -> DataFrame:
    """Per frequency bucket of the target: n, unique targets, share, median frequency, hr@k, ndcg@k, mrr; empty buckets stay with null metrics.

    records: target, rank (null: not found). freq: item, freq (missing: 0)."""
    rec = records.join(freq, records["target"] == freq["item"], "left").select("target", "rank", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
    rec = rec.withColumn("frequency_bucket", frequency_bucket(F.col("freq"), boundaries))
    aggs = [F.count("*").alias("n"), F.count_distinct("target").alias("unique_targets"), F.percentile("freq", 0.5).alias("median_frequency")]
    for k in ks:
        hit, ndcg, mrr = rank_metrics(F.col("rank"), k)
        aggs += [F.avg(hit).alias(f"hr{k}"), F.avg(ndcg).alias(f"ndcg{k}")]
    aggs.append(F.avg(mrr).alias("mrr"))
    got = rec.groupBy("frequency_bucket").agg(*aggs)
    table = bucket_table(records.sparkSession, boundaries)
    out = table.join(got, "frequency_bucket", "left").fillna(0, ["n", "unique_targets"])
    return out.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy()).cast("double")))  # one row a bucket


def per_item(records: DataFrame) -> DataFrame:
    """item_id, frequency (largest), frequency_bucket (first), mean metrics."""
    return records.groupBy("item_id").agg(F.max("frequency").alias("frequency"), F.min("frequency_bucket").alias("frequency_bucket"), *[F.avg(c).alias(c) for c in ("hr10", "ndcg10", "mrr")])


def balanced_threshold(values: DataFrame, value: str, *group: str) -> DataFrame:
    """group, threshold: the distinct value v (not the last) that splits `<= v` and `> v` most evenly, the smaller on ties; groups with one distinct value are left out."""
    cnt = values.groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group)
    cum = cnt.select(*group, value, F.sum("c").over(w.orderBy(value)).alias("left"), F.sum("c").over(w).alias("total"), F.max(value).over(w).alias("top"))
    keep = cum.where(F.col(value) < F.col("top"))
    best = F.min_by(value, F.struct(F.abs(2 * F.col("left") - F.col("total")), F.col(value))).alias("threshold")
    return keep.groupBy(*group).agg(best) if group else keep.agg(best).where("threshold is not null")


def assign_quality(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """rows with threshold and quality high/low; rows of groups without threshold go."""
    t = balanced_threshold(rows, value, *group)
    out = rows.join(F.broadcast(t), list(group)) if group else rows.crossJoin(F.broadcast(t))  # one row a bucket, or one row
    return out.withColumn("quality", F.when(F.col(value) > F.col("threshold"), "high").otherwise("low"))


def transfer_summary(uid: DataFrame, sid: DataFrame, transfer: DataFrame) -> DataFrame:
    """Per (frequency_bucket, quality): n, mean metrics of both rankings and their difference (sid - uid)."""
    key = ["item_id", "frequency", "frequency_bucket"]
    names = ["hr10", "ndcg10", "mrr"]
    a = uid.select(*key, *[F.col(c).alias(f"uid_{c}") for c in names])
    b = sid.select(*key, *[F.col(c).alias(f"sid_{c}") for c in names])
    rows = assign_quality(a.join(b, key).join(transfer, "item_id"), "tq", "frequency_bucket")
    means = [F.avg(f"{s}_{c}").alias(f"{s}_{c}") for s in ("uid", "sid") for c in names]
    delta = [(F.avg(f"sid_{c}") - F.avg(f"uid_{c}")).alias(f"delta_{c}") for c in names]
    return rows.groupBy("frequency_bucket", "quality").agg(F.count("*").alias("n"), F.avg("tq").alias("mean_tq"), *means, *delta)
