"""Helpers shared by the training-data operators: tables, shared storage, skew-safe semi joins, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes up to which a key-only side is small enough to be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only an unset one (tests) gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='histria-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/histria/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application wrote with materialize(); results not yet written need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts that go to a Python worker at once, where the session says nothing else (Spark's default: 10,000).
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def at_home(f: Callable) -> Callable:
    """f(spark, ...) with this package on the path of the Python workers, wherever the driver was started, and with Arrow
    batches that suit long texts."""

    @wraps(f)
    def run(spark: SparkSession, *args):
        home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
        if home not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, home]))
        if spark.conf.get(_ROWS) == "10000":
            spark.conf.set(_ROWS, BATCH_ROWS)
        return f(spark, *args)

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing that is already written."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing needs any more."""
    for df in frames:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: int = 16, arrays: tuple[str, ...] = ()) -> DataFrame:
    """df with a broadcast hint if its rows, of `width` bytes each and 4 for each element of the named arrays, stay below
    BROADCAST_BYTES; unchanged (so shuffled) otherwise."""
    size = F.lit(width).cast("long")
    for a in arrays:
        size += 4 * F.size(a)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def numbers(column: DataFrame) -> np.ndarray:
    """A bounded column of hashes on the driver, sorted, 8 bytes each."""
    return np.sort(column.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def digest_sum(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent prefix sums: span_hash over both gives a span's 128-bit digest."""
    return K.byte_prefix(data, False), K.byte_prefix(255 - data, False)


def parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Edges that one task closes. A set of no more is closed in one; in a larger one each task first closes what it holds.
EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and of each the smallest node of its component. All roots hook to their smallest neighbour
    at once, then paths are halved to their ends, until no edge joins two roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (far := up[up]).tobytes() != up.tobytes():
            up = far
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def closed(edges: DataFrame, limit: int, whole: bool = False) -> DataFrame:
    """(a, b: long) with a > b: for each `limit` edges of a partition, each node and the smallest one it is connected with
    by them; whole: for all edges of the partition at once, smallest nodes themselves (a = b) included."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            node, root = roots(*(np.concatenate(x) for x in zip(*held)))
            keep = np.ones(len(node), bool) if whole else node != root
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])

        for t in it:
            held.append((t.column("a").to_numpy(), t.column("b").to_numpy()))
            size += t.num_rows
            if size >= limit and not whole:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60, limit: int = EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b: long). Returns (node, component), component = smallest node.

    Each task replaces the edges it holds by the stars of their components. Up to `limit` counted edges that are left then
    are closed in one task (16 bytes an edge). More of them take alternate large-star and small-star steps; each is one
    aggregation with map-side combine and one join that adaptive execution may split, so a node with millions of
    neighbours is no hot task. Each round is a written table. Edges of a node with itself or with null are left out.
    """
    now = materialize(closed(edges.where("a <> b"), limit), "edges")
    count = now.count()
    if count > limit:
        one = materialize(now.distinct(), "edges")
        drop_tables(now)
        now, count = one, one.count()
    last = None
    for _ in range(max_rounds):
        if count <= limit:
            found = materialize(closed(now.coalesce(1), limit, whole=True), "components")
            drop_tables(now)
            return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(closed(new.where("a <> b"), limit).distinct(), "edges")
        print_of = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        drop_tables(now)
        now, count = new, print_of[0]
        if print_of == last and print_of[0] == print_of[2]:
            break
        last = print_of
    else:
        raise RuntimeError("components: no fixed point")
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends).distinct()


def crc_of(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, chosen by a hash of the key; all if there are no more."""
    total = df.count()
    return df if total <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000_000)) < int(rows / total * 1e9))


def tiles(members: DataFrame, tile: int, band: Column, reach: int, salt: str) -> DataFrame:
    """members (cluster and more) once for every tile (bi, bj) they have to be in, with their own block.

    A cluster of up to `tile` members is one block. A larger one is cut by band (a size class of the member) and, within
    a band, by a hash of the salt column into blocks of about `tile`; each two blocks meet in a tile unless their bands
    are more than `reach` apart. Sizes come from counts per (cluster, band): no task holds a cluster.
    """
    banded = members.withColumn("band", band)
    total = banded.groupBy("cluster").agg(F.count("*").alias("total"))
    per = banded.groupBy("cluster", "band").agg(F.count("*").alias("cnt")).join(total, "cluster")
    per = per.select("cluster", "band", F.when(F.col("total") <= tile, 0).otherwise(F.ceil(F.col("cnt") / tile)).cast("int").alias("parts"))
    per = materialize(per, "bands")
    whole = per.where("parts = 0").select("cluster", "band", F.lit(0).alias("part"), F.lit("0").alias("bi"), F.lit("0").alias("bj"), F.lit("0").alias("block"))
    cut = per.where("parts > 0").select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("block", F.concat_ws(".", "band", "part"))
    other = cut.select("cluster", F.col("band").alias("band2"), F.col("block").alias("block2"))
    met = cut.join(other, "cluster").where(F.abs(F.col("band") - F.col("band2")) <= reach)
    met = met.select("cluster", "band", "part", F.least("block", "block2").alias("bi"), F.greatest("block", "block2").alias("bj"), "block")
    placed = banded.join(per, ["cluster", "band"]).withColumn("part", F.when(F.col("parts") <= 1, 0).otherwise(F.pmod(F.xxhash64(salt), F.greatest("parts", F.lit(1)))).cast("int"))
    return placed.join(whole.unionByName(met), ["cluster", "band", "part"]).drop("band", "part", "parts")
