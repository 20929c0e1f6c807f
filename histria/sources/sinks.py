"""Outputs: stage tables with manifests, reports by suffix, small rendered tables."""

from __future__ import annotations

import contextlib
import json
import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _step(what: str) -> None:
    """Called before each operation on shared files; tests put other writers' work here."""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through Spark's file systems, so any store works: written aside under a name of its own, then renamed over the old
    file in one operation, so a reader sees the old text or the new one."""
    target, fs = _path(spark, path)
    aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _step("replace")
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), how)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file: of several that try, one does."""
    p, fs = _path(spark, path)
    _step("create")
    try:
        out = fs.create(p, False)
    except Exception:  # the file systems' exceptions share no type
        if not fs.exists(p):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    s = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
    finally:
        s.close()


def stage(spark: SparkSession, folder: str, manifest: dict, build, wait_seconds: float = 0.0) -> dict[str, DataFrame]:
    """Tables of a stage: read if the folder's manifest says they were built from the same settings, else build() and write.

    The manifest is written last, so a stage that broke off is built again; one process builds at a time."""
    current = lambda: json.loads(read_text(spark, f"{folder}/manifest.json") or "{}")
    fits = lambda kept: {k: kept.get(k) for k in manifest} == json.loads(json.dumps(manifest))
    if not fits(current()):
        with only_writer(spark, folder, wait_seconds=wait_seconds):
            if not fits(current()):
                _build_stage(spark, folder, manifest, build)
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in current()["tables"]}


def _build_stage(spark: SparkSession, folder: str, manifest: dict, build) -> None:
    tables = build()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    write_text(spark, f"{folder}/manifest.json", json.dumps({**manifest, "tables": sorted(tables)}, sort_keys=True))


def report(df: DataFrame, path: str) -> None:
    """A per-item report: parquet, csv or json by suffix."""
    kind = path.rpartition(".")[2]
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for .{kind}")
    w = df.write.mode("overwrite")
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or list(rows[0]) if rows else columns or []
    cell = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def statistics(summary: DataFrame, path: str) -> None:
    """A small summary (one row a dataset) as csv, md or json."""
    rows = [r.asDict(recursive=True) for r in summary.collect()]
    kind = path.rpartition(".")[2]
    if kind == "md":
        text = markdown(rows, summary.columns) + "\n"
    elif kind == "json":
        text = json.dumps(rows, indent=2, default=str) + "\n"
    elif kind == "csv":
        import csv
        import io

        buf = io.StringIO()
        w = csv.DictWriter(buf, summary.columns)
        w.writeheader()
        w.writerows(rows)
        text = buf.getvalue()
    else:
        raise ValueError(f"no writer for .{kind}")
    write_text(summary.sparkSession, path, text)


def _batches(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """(number of the newest list, batches of the newest whole one)."""
    p, fs = _path(spark, folder)
    if not fs.exists(p):
        return 0, []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    numbers = sorted((int(n[8:-5]) for n in names if re.fullmatch(r"batches-\d{9}\.json", n)), reverse=True)
    for n in numbers:
        _step("read")
        with contextlib.suppress(ValueError):  # broken off while it was written
            return numbers[0], json.loads(read_text(spark, f"{folder}/batches-{n:09d}.json") or "")
    return (numbers[0] if numbers else 0), []


def extend_cache(spark: SparkSession, folder: str, wanted: DataFrame, build, key: str = "item", wait_seconds: float = 600.0, stale_seconds: float = 600.0) -> DataFrame:
    """Rows for the wanted keys from a growing cache. Keys asked for before are covered even if they had no valid row.

    A batch's rows and covered keys are in a folder of their own and count once a list of batches names it. Lists are
    numbered and never change; the newest holds. A number can be taken once only: a writer that finds its number taken, by
    one that took over its lock, begins again from what is there. So no batch is lost and no key is written twice, and a
    writer that breaks off leaves nothing that is read. Who finds all keys covered takes no lock."""
    keys = wanted.select(key).distinct()

    def missing(batches: list[str]) -> DataFrame:
        return keys.join(spark.read.parquet(*[f"{folder}/{b}/covered" for b in batches]), key, "left_anti") if batches else keys

    _, batches = _batches(spark, folder)
    if not batches or not missing(batches).isEmpty():
        with only_writer(spark, folder, stale_seconds, wait_seconds):
            while True:
                number, batches = _batches(spark, folder)
                new = missing(batches)
                if batches and new.isEmpty():
                    break
                batch = f"batch-{uuid.uuid4().hex}"
                new.write.parquet(f"{folder}/{batch}/covered")
                build(spark.read.parquet(f"{folder}/{batch}/covered")).write.parquet(f"{folder}/{batch}/rows")
                create_text(spark, f"{folder}/batches-{number + 1:09d}.json", json.dumps([*batches, batch]))
    return spark.read.parquet(*[f"{folder}/{b}/rows" for b in batches]).join(keys, key, "left_semi")


@contextlib.contextmanager
def only_writer(spark: SparkSession, folder: str, stale_seconds: float = 600.0, wait_seconds: float = 0.0, beat_seconds: float = 30.0):
    """Holds `folder`/writer.lock, which only one process can create, and touches it while the block runs. One that is held
    raises after wait_seconds. A lock not touched for stale_seconds is moved aside, which one of several can do; if what was
    moved is not the lock that was found stale, it goes back. A lock holds its owner's token and only the owner deletes it.

    A process that slept through stale_seconds can still run beside the one that took over: what must not be lost is
    published by create_text()."""
    path, fs = _path(spark, f"{folder}/writer.lock")
    token, until, done = uuid.uuid4().hex, time.monotonic() + wait_seconds, threading.Event()
    while not create_text(spark, f"{folder}/writer.lock", token):
        with contextlib.suppress(Exception):  # it may go meanwhile
            found, touched = read_text(spark, f"{folder}/writer.lock"), fs.getFileStatus(path).getModificationTime() / 1000
            if time.time() - touched > stale_seconds:
                aside, _ = _path(spark, f"{folder}/writer.lock.{token}")
                _step("take over")
                if fs.rename(path, aside):
                    if read_text(spark, f"{folder}/writer.lock.{token}") != found:
                        fs.rename(aside, path)
                    else:
                        fs.delete(aside, False)
                continue
        if time.monotonic() >= until:
            raise TimeoutError(f"{folder} has another writer")
        time.sleep(min(1.0, max(0.05, wait_seconds / 10)))

    def mine() -> bool:
        return read_text(spark, f"{folder}/writer.lock") == token

    def beat() -> None:
        while not done.wait(beat_seconds):
            if mine():
                fs.setTimes(path, int(time.time() * 1000), -1)

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        _step("release")
        if mine():
            fs.delete(path, False)


def stage_sizes(spark: SparkSession, root: str) -> DataFrame:
    """stage, data, files, bytes of root/<stage>/<data>/...: from the files' listing, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    parts = F.split(F.regexp_replace("path", rf"^.*?\Q{base}\E/", ""), "/")
    named = files.select(F.get(parts, F.lit(0)).alias("stage"), F.get(parts, F.lit(1)).alias("data"), F.size(parts).alias("depth"), "length").where("depth > 2")
    return named.groupBy("stage", "data").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def chat_export(samples: DataFrame, codes: DataFrame, system: str, prompt: str, user: str = "user") -> DataFrame:
    """user, messages (JSON), metadata (JSON): histories and targets as code texts. Every id must have codes.

    samples: user, history, target. codes: item, codes."""
    from histria.functions.text import code_text, messages

    texts = codes.select("item", code_text(F.col("codes")).alias("t"))
    long = samples.select(user, "target", F.posexplode("history").alias("pos", "item")).join(texts, "item", "left")
    checked = F.coalesce("t", F.raise_error(F.concat(F.lit("no codes for "), F.col("item").cast("string"))).cast("string"))
    h = long.groupBy(user, "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", checked.alias("t")))), lambda x: x["t"]), "").alias("h"))
    known = h.join(texts.select(F.col("item").alias("target"), F.col("t").alias("answer")), "target", "left")
    missing = F.raise_error(F.concat(F.lit("no codes for "), F.col("target").cast("string"))).cast("string")
    out = known.withColumn("answer", F.coalesce("answer", missing))
    return out.select(user, messages(F.lit(system), F.concat(F.lit(prompt), F.col("h")), F.col("answer")).alias("messages"), F.to_json(F.struct(F.col(user), F.col("target"))).alias("metadata"))
