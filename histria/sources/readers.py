"""Raw inputs of sequence datasets. Schemas are given, never inferred; column pruning and filters reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEWS = "nid STRING, cat STRING, subcat STRING, title STRING, abs STRING, url STRING, tent STRING, aent STRING"
BEHAVIOURS = "imp STRING, uid STRING, time STRING, history STRING, predict STRING"


def tsv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, header: bool = False) -> DataFrame:
    """Tab-separated rows without quoting. header: the first line is dropped and its names replaced by the schema's."""
    out = spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", enforceSchema=True)
    return out.select(*columns) if columns else out


def delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, encoding: str = "UTF-8", sep: str = ",", header: bool = True) -> DataFrame:
    out = spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding, enforceSchema=True, escape='"')
    return out.select(*columns) if columns else out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzipped JSON lines (a gzip file is one task: recompress or split large ones)."""
    return spark.read.schema(schema).json(path)


def parquet(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """Renamed columns only: parquet(spark, p, user="uid", history="clicks")."""
    return spark.read.parquet(path).select(*[F.col(src).alias(dst) for dst, src in columns.items()])


def first_rows(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The first n rows in an explicit order: files have none once they are split."""
    return rows.orderBy(order).limit(n)


def news_items(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, NEWS, ["nid", "cat", "subcat", "title", "abs"])


def behaviours(spark: SparkSession, path: str, time_format: str = "M/d/yyyy h:mm:ss a") -> DataFrame:
    """uid, time (null where it can't be read), history as an array of ids."""
    from histria.functions.text import words

    rows = tsv(spark, path, BEHAVIOURS, ["uid", "time", "history"])
    return rows.select("uid", F.try_to_timestamp("time", F.lit(time_format)).alias("time"), F.coalesce(words(F.col("history")), F.array().cast("array<string>")).alias("history"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 0 in its file), place (from 0 over all files in the order of their names).

    Spark reads a file in blocks; lines of a block are read in order into one task. So a line's number is what the blocks
    before it hold and its own place in the block: one pass that counts (a row a block) and one that reads."""
    meta = F.col("_metadata")
    text = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id_"))
    per = text.groupBy("file", "block").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = lambda w: F.coalesce(F.sum("n_").over(w.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "block", "first_", before(Window.partitionBy("file")).alias("l_"), before(Window.partitionBy(F.lit(1))).alias("p_"))
    at = F.col("id_") - F.col("first_")
    return text.join(per, ["file", "block"]).select("value", "file", (F.col("l_") + at).alias("line"), (F.col("p_") + at).alias("place"))


def capped_fields(spark: SparkSession, path: str, columns: list[str], rows: int, sep: str = ",", header: bool = True) -> DataFrame:
    """The first `rows` lines of the files, cut at every separator (no quoting), as text columns: the first fields only.
    With header, each file's first line goes and does not count."""
    lines = numbered_lines(spark, path)
    if header:
        files = lines.select("file").distinct()
        earlier = files.select("file", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("file")).alias("headers"))  # a row a file
        lines = lines.join(earlier, "file").where("line > 0").withColumn("place", F.col("place") - F.col("headers"))
    parts = F.split("value", re.escape(sep))
    return lines.where(F.col("place") < rows).select("place", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def capped_json(spark: SparkSession, path: str, schema: str, rows: int) -> DataFrame:
    """The first `rows` lines of the files as JSON objects, with their place. A line that is none gives nulls."""
    return numbered_lines(spark, path).where(F.col("place") < rows).select("place", F.from_json("value", schema).alias("r")).select("place", "r.*")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def answers(rows: DataFrame, metadata: str = "metadata", key: str = "answer_pid") -> DataFrame:
    """rows with answers ARRAY<BIGINT> from a JSON text."""
    return rows.withColumn("answers", F.coalesce(F.from_json(metadata, f"{key} ARRAY<BIGINT>")[key], F.array().cast("array<bigint>")))


def captions(spark: SparkSession, path: str, ids: DataFrame, *order: str) -> DataFrame:
    """item, caption of the wanted ids, the first of repeated ones."""
    from histria.operators.sequences import keep_first

    rows = parquet(spark, path, item="pid", caption="dense_caption")
    return keep_first(rows.join(ids.select("item").distinct(), "item", "left_semi"), "item", *(order or ("caption",)))


def embedding_shards(spark: SparkSession, folder: str, exclude: str = "filtered") -> DataFrame:
    """All shards of a folder but those whose file name begins with `exclude`."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.where(~F.element_at(F.split(F.input_file_name(), "/"), -1).startswith(exclude))


def pooled_vectors(shards: DataFrame, ids: DataFrame, columns: list[str], item: str = "pid") -> DataFrame:
    """item, v: complete vectors of the wanted ids, nested ones pooled, all columns one after the other."""
    from histria.operators.vectors import is_complete, mean_pool

    out = shards.select(F.col(item).alias("item"), *columns).join(ids.select("item").distinct(), "item", "left_semi")
    kinds = dict(out.dtypes)
    for c in columns:
        v = mean_pool(F.col(c)) if kinds[c].startswith("array<array") else F.transform(c, lambda x: x.cast("double"))
        out = out.where(F.size(c) > 0).withColumn(c, v)
    for c in columns:
        out = out.where(is_complete(F.col(c)))
    return out.select("item", F.concat(*columns).alias("v"))


def by_suffix(spark: SparkSession, path: str, schema: str | None = None, id_col: str | None = None) -> DataFrame:
    """csv, json (lines or one array) or parquet by the path's suffix; the id as text."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind == "parquet":
        out = spark.read.parquet(path)
    elif kind == "csv":
        out = spark.read.csv(path, schema=schema, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)
    elif kind == "json":
        r = spark.read.option("multiLine", True)
        out = (r.schema(schema) if schema else r).json(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return out.withColumn(id_col, F.col(id_col).cast("string")) if id_col else out


def ranking_records(spark: SparkSession, path: str, schema: str = "records ARRAY<STRUCT<target_uid: BIGINT, raw_item_id: STRING, frequency: BIGINT, frequency_bucket: STRING, rank: INT>>") -> DataFrame:
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    if not rows.where("records is null").isEmpty():
        raise ValueError("a report without records")
    return rows.select(F.explode("records").alias("r")).select("r.*")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows with src_pos, an explicit order for keep-first rules, by (key, all columns)."""
    w = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    return rows.withColumn("src_pos", F.row_number().over(w) - 1)


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet path opens."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except Exception:  # noqa: BLE001
        return False
    return True
