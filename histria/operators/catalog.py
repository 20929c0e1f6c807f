"""Run catalogues: nested meta.json files as a table, filters, comparison, artifact choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .shared import dealt, saved


def runs(spark: SparkSession, root: str) -> DataFrame:
    """path, config (map of texts), metrics (map of numbers), data, model, phase, seed from meta.json files below root."""
    schema = "config MAP<STRING, STRING>, identity MAP<STRING, STRING>, test_metrics MAP<STRING, DOUBLE>, seed STRING"
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").schema(schema).json(root)
    parts = F.split(F.input_file_name(), "/")
    up = lambda k: F.try_element_at(parts, F.lit(-k))
    pick = lambda k, other: F.coalesce(F.try_element_at("config", F.lit(k)), F.try_element_at("identity", F.lit(k)), other)
    return raw.select(
        F.input_file_name().alias("path"), "config", F.col("test_metrics").alias("metrics"), pick("data", up(4)).alias("data"), pick("model", up(3)).alias("model"),
        up(2).alias("signature"), F.coalesce("seed", pick("seed", F.lit(None).cast("string"))).alias("seed"),
    )


def matches(value: Column, wanted: str) -> Column:
    """Case-insensitive equality with one of a comma list; numbers within 1e-12."""
    out = F.lit(False)
    for w in (x.strip() for x in wanted.split(",")):
        try:
            close = F.abs(value.try_cast("double") - F.lit(float(w))) <= 1e-12
        except ValueError:
            close = F.lit(False)
        out = out | F.coalesce(close, F.lit(False)) | (F.lower(value.cast("string")) == w.lower())
    return F.coalesce(out, F.lit(w_is_null(wanted)) & value.isNull())


def w_is_null(wanted: str) -> bool:
    return wanted.strip().lower() in ("null", "none")


def search(rows: DataFrame, filters: dict[str, str], limit: int | None = None, exclude_phase: str | None = None) -> DataFrame:
    """Runs that fit all filters (columns, or keys of config), sorted by (data, model, signature, seed)."""
    for k, v in filters.items():
        rows = rows.where(matches(F.col(k) if k in rows.columns else F.try_element_at("config", F.lit(k)), v))
    if exclude_phase:
        rows = rows.where(~F.coalesce(F.col("path").contains(f"/{exclude_phase}/"), F.lit(False)))
    rows = rows.orderBy("data", "model", "signature", "seed")
    return rows.limit(limit) if limit else rows


def by_expressions(rows: DataFrame, *expressions: str) -> DataFrame:
    """`key=value` filters."""
    return search(rows, dict(e.split("=", 1) for e in expressions))


def differing(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, field, value of the config fields that differ between the runs."""
    long = rows.select(key, F.explode("config").alias("field", "value"))
    total = rows.agg(F.count("*").alias("runs"))
    per = long.groupBy("field").agg(F.count_distinct("value").alias("d"), F.count("*").alias("c")).crossJoin(F.broadcast(total)).where("d > 1 or c < runs").select("field")  # one row of totals
    return long.join(per, "field").select(key, "field", "value")


def metric_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.map_keys("metrics")).alias("key")).distinct()


def newest(rows: DataFrame, filters: dict[str, str], *order: str) -> DataFrame:
    """The one fitting run that is last by the order columns."""
    return search(rows, filters).orderBy(*[F.desc(c) for c in order]).limit(1)


#: Entries of a side in a tile of pairs, and pairs of a task.
SIDE, PAIRS = 1024, 1 << 21


def experiment_pairs(entries: DataFrame) -> DataFrame:
    """uid_name, sid_name of experiments with the same data, model, source and add-ons, one with uid, the other with sid.

    entries: name, data, model, source, repr_type. An equi-join on the key, not a product. Pairs of a key are a product all
    the same: where there are many, each key's sides are cut into blocks by their names, and tiles of two blocks are dealt
    into as many tasks as their pairs need. No task holds a key, and the tasks are those of the result, not of the entries."""
    from histria.functions.text import add_ons

    e = entries.withColumn("extra", add_ons(F.col("repr_type"))).withColumn("kinds", F.split("repr_type", r"\+"))
    key = ["data", "model", "source", "extra"]
    uid = e.where(F.array_contains("kinds", "uid") & ~F.array_contains("kinds", "sid")).select(*key, F.col("name").alias("uid_name"))
    sid = e.where(F.array_contains("kinds", "sid") & ~F.array_contains("kinds", "uid")).select(*key, F.col("name").alias("sid_name"))
    counts = uid.groupBy(*key).agg(F.count("*").alias("u_")).join(sid.groupBy(*key).agg(F.count("*").alias("s_")), key)
    n = shared.parts(entries.sparkSession, counts.agg(F.coalesce(F.sum(F.col("u_") * F.col("s_")), F.lit(0))).first()[0], PAIRS)
    if not n:
        return uid.join(sid, key)
    blocks = counts.select(*key, *[F.ceil(F.col(c) / SIDE).cast("int").alias(c) for c in ("u_", "s_")])
    place = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = uid.join(blocks, key).select(*key, "uid_name", place("uid_name", "u_").alias("i_"), every("s_").alias("j_"))
    right = sid.join(blocks, key).select(*key, "sid_name", place("sid_name", "s_").alias("j_"), every("u_").alias("i_"))
    # One column, as a column of the key may be a constant, by which a join does not deal.
    left, right = (x.withColumn("tile_", F.to_json(F.struct(*key, "i_", "j_"))) for x in (left, right))
    return dealt(left, n, "tile_").join(dealt(right.select("tile_", "sid_name"), n, "tile_").hint("merge"), "tile_").select(*key, "uid_name", "sid_name")


def deletable(rows: DataFrame, host: str, alive: list[int]) -> DataFrame:
    """Runs without metrics whose process on this host is gone. rows: path, host, pid, metrics."""
    gone = ~F.col("pid").isin(alive) if alive else F.lit(True)
    return rows.where((F.col("host") == host) & gone & F.coalesce(F.size("metrics") <= 0, F.lit(True)))


def resolve_aliases(entries: DataFrame, max_steps: int | None = None) -> DataFrame:
    """name, target after following alias chains (entries: name, alias or null) of any length, or of up to about max_steps;
    cycles and chains to missing entries resolve to null.

    Pointer doubling until no target changes (cycles: until the steps reach the number of entries): a join a round."""
    now = entries.select("name", F.coalesce("alias", "name").alias("target"))
    most = entries.count() if max_steps is None else max_steps
    steps = 1
    while steps < most:
        hop = now.select(F.col("name").alias("target"), F.col("target").alias("next"))
        both = now.join(hop, "target", "left").select("name", F.coalesce("next", "target").alias("target"), F.coalesce(F.col("next") != F.col("target"), F.lit(False)).alias("moved"))
        both = saved(both)
        now = both.drop("moved")
        if both.where("moved").isEmpty():
            break
        steps *= 2
    ends = entries.where("alias is null").select(F.col("name").alias("target"), F.lit(True).alias("real"))
    return now.join(ends, "target", "left").select("name", F.when(F.col("real"), F.col("target")).alias("target"))


def reconcile(local: DataFrame, remote: DataFrame, *priority: str) -> DataFrame:
    """signature, seed, action: keep (both), upload (local only), orphan (remote only); the best local row by the priority columns."""
    w = Window.partitionBy("signature", "seed").orderBy(*[F.desc(c) for c in priority])
    best = local.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").select("signature", "seed", F.lit(True).alias("l"))
    r = remote.select("signature", "seed", F.lit(True).alias("r")).distinct()
    action = F.when(F.col("l") & F.col("r"), "keep").when(F.col("l"), "upload").otherwise("orphan")
    return best.join(r, ["signature", "seed"], "full").select("signature", "seed", action.alias("action"))


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of a few settings (small by nature)."""
    import itertools

    rows = [dict(zip(axes, map(str, c))) for c in itertools.product(*axes.values())]
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "run int, config map<string,string>")
