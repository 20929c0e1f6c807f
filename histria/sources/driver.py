"""The driver's tables in the roles of a sequence data set: items, interactions, events, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histria.operators.shared import PAIRS, dealt, parts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_parts(spark: SparkSession, sf_dir: str, window: int | None = None) -> int | None:
    """Tasks for the log's rows, or with a window for their pairs. Parquet files know their rows."""
    rows = read(spark, sf_dir, "lineitem").count()
    return parts(spark, rows * window, PAIRS) if window else parts(spark, rows)


def _ordered_lines(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    """user, item, ts, l_orderkey, l_linenumber: line items with their orders, both dealt into n tasks."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    if n:  # both sides lie by order then
        lines, orders = dealt(lines, n, "l_orderkey"), dealt(orders, n, "o_orderkey").hint("merge")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("user", F.col("l_partkey").alias("item"), "ts", "l_orderkey", "l_linenumber")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, ts: interactions() without places, and so without a shuffle by user."""
    return _ordered_lines(spark, sf_dir, log_parts(spark, sf_dir)).select("user", "item", "ts")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, ts, pos (from 0): line items in order of date, order, line and part."""
    n = log_parts(spark, sf_dir)
    w = Window.partitionBy("user").orderBy("ts", "l_orderkey", "l_linenumber", "item")
    return dealt(_ordered_lines(spark, sf_dir, n), n, "user").select("user", "item", "ts", (F.row_number().over(w) - 1).alias("pos"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, history, folded straight from the log: one shuffle by user."""
    from histria.operators.sequences import fold

    n = log_parts(spark, sf_dir)
    return fold(dealt(_ordered_lines(spark, sf_dir, n), n, "user"), "user", "item", "ts", "l_orderkey", "l_linenumber")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, event_type, ts, pos."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item"), "event_type", "ts", (F.row_number().over(w) - 1).alias("pos"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "embedding", "label")
