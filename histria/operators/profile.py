"""Dataset statistics, distributions, overlaps and column profiles. Every operator is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running

PERCENTS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: History-length buckets of the formatted statistics (fixed values).
LENGTH_BUCKETS = ((0, 0), (1, 1), (2, 2), (3, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, 500), (501, None))


def stage_counts(histories: DataFrame, user: str = "user") -> DataFrame:
    return histories.agg(F.count("*").alias("rows"), F.count_distinct(user).alias("users"), F.coalesce(F.sum(F.size("history")), F.lit(0)).cast("long").alias("interactions"))


def describe(rows: DataFrame, value: Column, percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    """count, sum, mean, population std, min, linear-interpolated percentiles, max.

    The percentiles hold one count a distinct value, so this is for lengths, frequencies and the like; order.percentiles
    serves continuous values."""
    v = value.cast("double")
    return rows.agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), *[F.percentile(v, p).alias(f"p{round(100 * p)}") for p in percents], F.max(v).alias("max"))


def bucket_name(low: int, high: int | None) -> str:
    return f"{low}+" if high is None else str(low) if low == high else f"{low}-{high}"


def count_buckets(rows: DataFrame, value: Column, buckets: tuple = LENGTH_BUCKETS) -> DataFrame:
    """bucket, n, ratio for every bucket, empty ones included, and `unmatched`. Buckets may overlap: a value counts in each."""
    inside = [(bucket_name(a, b), (value >= a) & (value <= b) if b is not None else value >= a) for a, b in buckets]
    none = ~inside[0][1]
    for _, c in inside[1:]:
        none = none & ~c
    sums = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"b{i}") for i, (_, c) in enumerate([*inside, ("unmatched", none)])]
    one = rows.agg(F.count("*").alias("total"), *sums)
    table = F.array(*[F.struct(F.lit(i).alias("bucket_index"), F.lit(name).alias("bucket"), F.coalesce(f"b{i}", F.lit(0)).alias("n")) for i, (name, _) in enumerate([*inside, ("unmatched", None)])])
    out = one.select("total", F.explode(table).alias("x")).select("x.*", F.coalesce(F.try_divide(F.col("x.n").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("ratio"))
    return out


def equal_width(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin (1..bins), n: right-closed equal-width bins between minimum and maximum."""
    v = rows.select(value.cast("double").alias("v")).where("v is not null")
    lim = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("lo")) / width))))
    return v.crossJoin(F.broadcast(lim)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # lim is one row


def dataset_statistics(histories: DataFrame, items: DataFrame, cold_below: int, sources: str | None = None, user: str = "user") -> DataFrame:
    """One row: sizes, density, coverage, cold share, length and frequency distributions."""
    h = histories.withColumn("n_", F.size("history"))
    freq = histories.select(F.explode("history").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))
    by_user = h.agg(
        F.count("*").alias("sequences"), F.count_distinct(user).alias("users"), F.count_distinct(sources or user).alias("source_users"), F.sum("n_").cast("long").alias("interactions"),
        F.avg("n_").alias("mean_length"), F.percentile("n_", 0.5).alias("median_length"), F.percentile("n_", 0.9).alias("p90_length"), F.stddev_pop("n_").alias("std_length"), F.min("n_").alias("min_length"), F.max("n_").alias("max_length"),
    )
    by_item = freq.agg(
        F.count("*").alias("observed_items"), F.avg("freq").alias("mean_frequency"), F.percentile("freq", 0.5).alias("median_frequency"), F.stddev_pop("freq").alias("std_frequency"),
        F.sum((F.col("freq") < cold_below).cast("long")).alias("cold_items"),
    )
    catalog = items.agg(F.count_distinct("item").alias("catalog_items"))
    covered = freq.join(items.select("item").distinct(), "item", "left_semi").agg(F.count("*").alias("covered_items"))
    out = by_user.crossJoin(by_item).crossJoin(catalog).crossJoin(covered)  # four frames of one row
    cells = F.col("users") * F.col("catalog_items")
    return (
        out.withColumn("density_percent", 100 * F.try_divide(F.col("interactions").cast("double"), cells.cast("double")))
        .withColumn("sparsity_percent", 100 - F.col("density_percent"))
        .withColumn("cold_percent", 100 * F.try_divide(F.col("cold_items").cast("double"), F.col("observed_items").cast("double")))
        .withColumn("coverage_percent", 100 * F.try_divide(F.col("covered_items").cast("double"), F.col("catalog_items").cast("double")))
    )


def retention(rows: DataFrame) -> DataFrame:
    """rows(data, scale_percent, observed_items) with family (name without trailing digits) and retention against its largest scale."""
    fam = rows.withColumn("family", F.regexp_replace("data", r"\d+$", ""))
    top = F.max_by("observed_items", "scale_percent").over(Window.partitionBy("family"))
    return fam.withColumn("retention_percent", 100 * F.try_divide(F.col("observed_items").cast("double"), top.cast("double")))


def gini(counts: DataFrame, value: str = "cnt") -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending x.

    Ranks are arithmetic on the table of distinct counts, which is far smaller than the items: equal values take their
    places' sum at once, so no task sorts all items."""
    r = running(counts.groupBy(value).agg(F.count("*").alias("m")), [value], "m")
    places = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    one = r.agg(F.sum(places * F.col(value)).alias("weighted"), F.sum("m").cast("double").alias("n"), F.sum(F.col("m") * F.col(value)).cast("double").alias("total"))
    return one.select(F.coalesce(2 * F.try_divide("weighted", F.col("n") * F.col("total")) - F.try_divide(F.col("n") + 1, F.col("n")), F.lit(0.0)).alias("gini"))


def effective_items(counts: DataFrame, value: str = "cnt") -> DataFrame:
    """exp(entropy) = exp(ln T - sum(x ln x) / T): one pass, no join with the total."""
    x = F.col(value).cast("double")
    return counts.where(x > 0).agg(F.sum(x).alias("t"), F.sum(x * F.ln(x)).alias("s")).select(F.coalesce(F.exp(F.ln("t") - F.try_divide("s", "t")), F.lit(0.0)).alias("effective_items"))


def top_share(counts: DataFrame, ratio: float, value: str = "cnt") -> DataFrame:
    """Share of the ceil(ratio n) largest counts, from the table of distinct counts."""
    r = running(counts.groupBy(value).agg(F.count("*").alias("m")), [value], "m", descending=True)
    r = r.crossJoin(F.broadcast(r.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col(value)).alias("total"))))  # one row of totals
    inside = F.greatest(F.lit(0), F.least(F.col("m"), F.ceil(F.col("n") * ratio) - F.col("before")))
    return r.agg(F.try_divide(F.sum(inside * F.col(value)).cast("double"), F.max("total").cast("double")).alias("top_share"))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, dtype, rows, nulls, distinct, min_chars, mean_chars, max_chars: one scan for all columns."""
    kinds = dict(rows.dtypes)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        s = F.length(F.col(c).cast("string"))
        aggs += [F.count(c).alias(f"v{i}"), F.count_distinct(c).alias(f"d{i}"), F.min(s).alias(f"a{i}"), F.avg(s).alias(f"m{i}"), F.max(s).alias(f"z{i}")]
    table = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col("rows"), (F.col("rows") - F.col(f"v{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct"),
                 F.col(f"a{i}").cast("long").alias("min_chars"), F.col(f"m{i}").alias("mean_chars"), F.col(f"z{i}").cast("long").alias("max_chars"))
        for i, c in enumerate(columns)
    ])
    return rows.agg(*aggs).select(F.explode(table).alias("x")).select("x.*")


def history_profile(histories: DataFrame) -> DataFrame:
    n, u = F.size("history"), F.size(F.array_distinct("history"))
    return histories.agg(
        F.count("*").alias("rows"), F.sum((n == 0).cast("long")).alias("empty"), F.sum(n).cast("long").alias("interactions"), F.sum(u).cast("long").alias("unique_per_user"), F.sum(n - u).cast("long").alias("repeats"),
        F.sum((n > u).cast("long")).alias("users_with_repeats"), F.avg(n).alias("mean_length"), F.max(n).cast("long").alias("max_length"),
    )


def presence(rows: DataFrame, columns: list[str], size) -> DataFrame:
    """column, present, mean_size, max_size over rows where size(column) > 0 (array length or characters)."""
    out = None
    for c in columns:
        s = size(c)
        one = rows.agg(F.sum(F.when(s > 0, 1).otherwise(0)).cast("long").alias("present"), F.avg(F.when(s > 0, s)).alias("mean_size"), F.max(F.when(s > 0, s)).cast("long").alias("max_size")).select(F.lit(c).alias("column"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def overlaps(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """left, right, n_left, n_right, n_both for each two named sets: one aggregation of membership flags."""
    names = list(sets)
    tagged = None
    for i, n in enumerate(names):
        one = sets[n].select(F.col(key).alias("k"), F.lit(1 << i).alias("bit")).where("k is not null").distinct()
        tagged = one if tagged is None else tagged.unionByName(one)
    flags = tagged.groupBy("k").agg(F.bit_or("bit").alias("f")).groupBy("f").agg(F.count("*").alias("c"))  # at most 2**sets rows
    has = lambda *at: F.sum(F.when(F.expr(f"(f & {sum(1 << i for i in at)}) = {sum(1 << i for i in at)}"), F.col("c")).otherwise(0)).cast("long")
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = flags.agg(*[has(i).alias(f"n{i}") for i in range(len(names))], *[has(i, j).alias(f"p{i}_{j}") for i, j in pairs])
    table = F.array(*[F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"n{i}").alias("n_left"), F.col(f"n{j}").alias("n_right"), F.col(f"p{i}_{j}").alias("n_both")) for i, j in pairs])
    return one.select(F.explode(table).alias("x")).select("x.*")


def common_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that all frames have."""
    out = frames[0].select(key).where(F.col(key).isNotNull()).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def missing_items(histories: DataFrame, items: DataFrame) -> DataFrame:
    return histories.select(F.explode("history").alias("item")).distinct().join(items.select("item"), "item", "left_anti")


def seen_rate(targets: DataFrame, freq: DataFrame) -> DataFrame:
    """Share of targets that occur in training, and their mean training frequency (unseen: 0)."""
    t = targets.join(freq, "item", "left").select(F.coalesce("freq", F.lit(0)).alias("freq"))
    return t.agg(F.count("*").alias("targets"), F.sum((F.col("freq") > 0).cast("long")).alias("seen"), F.avg((F.col("freq") > 0).cast("double")).alias("seen_rate"), F.avg("freq").alias("mean_frequency"))


def coverage_by(ids: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """name, ids, covered, percent for each table of keys."""
    out = ids.select(key).distinct()
    for n, t in tables.items():
        out = out.join(t.select(F.col(key), F.lit(1).alias(n)).distinct(), key, "left")
    one = out.agg(F.count("*").alias("ids"), *[F.count(n).alias(n) for n in tables])
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.col("ids"), F.col(n).alias("covered"), (100 * F.try_divide(F.col(n).cast("double"), F.col("ids").cast("double"))).alias("percent")) for n in tables])
    return one.select(F.explode(table).alias("x")).select("x.*")
