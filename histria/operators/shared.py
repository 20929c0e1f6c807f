"""Checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only where it is unset and Spark runs on one machine (tests), a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='histria-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df from a written checkpoint: its lineage is cut, and a lost executor costs nothing that is written."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a task where a caller knows their number, and pairs made of them.
ROWS, PAIRS = 1 << 18, 1 << 20
#: From so many tasks on rows are dealt; fewer rows are left to Spark.
FEWEST = 4


def parts(spark: SparkSession, rows: int, each: int | None = None) -> int | None:
    """Tasks for so many rows, `each` (by default ROWS) in a task. Their number follows the rows, so that a task's memory grows neither with
    the input nor with the size that adaptive execution puts together. None (few rows): as the session has it."""
    n = -(-rows // (each or ROWS))
    return max(n, spark.sparkContext.defaultParallelism) if n > FEWEST else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df in n tasks by the keys; as it is without n."""
    return df.repartition(n, *keys) if n else df


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared one."""
    return f"{shared_folder(spark)}/histria/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
