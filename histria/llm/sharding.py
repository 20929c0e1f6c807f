"""Contiguous shards of nearly equal byte size, from global prefix sums (operator 4, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts, table

SHARDS = 40
ROW_BYTES = 16


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Adds `_b`: an ordered range bucket of key, a fixed function of the key, so that recomputed tasks agree."""
    cuts = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.lit(0)
    if cuts:  # a binary search over the sorted literals
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col(key) <= F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

        at = search(0, len(cuts))
    return df.withColumn("_b", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs gets shard and slot: shards are contiguous in id order and of nearly equal bytes.

    size = UTF-8 bytes of the text + 16. A row's place is its start in the global byte prefix sum: shard =
    floor((start + size / 2) * shards / total), so a shard's size is within one row of total / shards. The sum is
    taken in two levels: totals per range bucket of the id, their prefix sums (one row a bucket), then a running sum
    inside each bucket. A null text counts as empty (16 bytes); null ids come first; equal ids are ordered by text
    checksum and size, so repeated rows are interchangeable. No rows in, no rows out. Other columns of docs are not
    carried; join the result on the id. Only (id, size, crc) is shuffled, never the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), byte_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    rows = bucketed(slim, "doc_id", min(1024, 4 * parts(docs)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_b").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))  # at most 1,025 rows
    totals = totals.select("_b", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("_b").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(F.broadcast(totals), "_b").select(
        "doc_id", "size", "text_crc32", "total", (F.col("bytes0") + F.sum("size").over(inside) - F.col("size")).alias("start"), (F.col("n0") + F.row_number().over(inside) - 1).alias("at")
    )
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start + size) * {shards} div (2 * total)")).cast("int"))
    placed = materialize(placed.drop("total"), "places")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"), "start")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH z AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
c AS (SELECT r, doc_id, octet_length(x) + 16 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(x), '..'), lambda v: ('0x' || v)::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, z),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS place, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(39, (2 * start + size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
