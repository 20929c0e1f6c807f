"""Semantic codes and binary hashes: packing, offsets, collisions, quality, tries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two code arrays."""
    eq = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    step = lambda s, e: F.struct((s["on"] & e).alias("on"), F.when(s["on"] & e, s["n"] + 1).otherwise(s["n"]).alias("n"))
    return F.aggregate(eq, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step, lambda s: s["n"])


def hamming(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))


def prefix_neighbors(anchors: DataFrame, candidates: DataFrame, slots: int, k: int) -> DataFrame:
    """anchor, item, score, rank: the k candidates with the longest common code prefix, ties to the smaller item.

    anchors, candidates: item, codes (of `slots` codes each). An anchor takes at most k items from each length of prefix. Of
    the items under a prefix the 2 k smallest serve all its anchors, with at most k of each next code: whichever next code
    is the anchor's own (and so counts for a longer prefix), k others are left. One join a length, no pairs of items."""
    out = None
    for d in range(slots, -1, -1):
        key, deeper = F.slice("codes", 1, d).alias("prefix"), F.slice("codes", 1, min(d + 1, slots)).alias("deeper")
        c = candidates.select("item", key, deeper)
        child, whole = Window.partitionBy("deeper").orderBy("item"), Window.partitionBy("prefix").orderBy("item")
        c = c.withColumn("r", F.row_number().over(child)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= 2 * k + 2)
        a = anchors.select(F.col("item").alias("anchor"), key, F.slice("codes", 1, min(d + 1, slots)).alias("own"))
        met = a.join(c, "prefix").where(F.col("anchor") != F.col("item"))
        met = (met if d == slots else met.where("own <> deeper")).select("anchor", "item", F.lit(d).alias("score"))
        out = met if out is None else out.unionByName(met)
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "item")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pack_bits(bits: Column, n_bits: int, groups: int = 3) -> Column:
    """`groups` numbers of ceil(n_bits / groups) bits, most significant first, zeros filling the tail."""
    w = -(-n_bits // groups)
    padded = F.concat(bits, F.array_repeat(F.lit(0), w * groups - n_bits)) if w * groups > n_bits else bits
    return F.array(*[F.aggregate(F.slice(padded, g * w + 1, w), F.lit(0), lambda a, b: a * 2 + b.cast("int")) for g in range(groups)])


def offset_codes(codes: Column, size: int) -> Column:
    return F.transform(codes, lambda c, i: i * size + c)


def collision_ordinal(rows: DataFrame, code: str, item: str = "item") -> DataFrame:
    """rows with ordinal (from 0) inside each group of equal codes, in order of the id as text."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(code).orderBy(F.col(item).cast("string"))) - 1)


def sid_view(codes: DataFrame, slots: int, size: int) -> DataFrame:
    """item, value: offset codes and always a last collision token slots * size + ordinal."""
    return collision_ordinal(codes, "codes").select("item", F.array_append(offset_codes(F.col("codes"), size), slots * size + F.col("ordinal")).alias("value"))


def hash_view(bits: DataFrame, n_bits: int, groups: int = 3) -> DataFrame:
    """item, value: packed groups, remapped slot by slot to the dense rank of observed values, offset by the sizes of the slots before, and a collision token."""
    packed = bits.select("item", pack_bits(F.col("bits"), n_bits, groups).alias("p"))
    seen = packed.select(F.posexplode("p").alias("slot", "val")).distinct()  # at most groups * 2**ceil(n_bits / groups) rows
    dense = seen.select("slot", "val", (F.dense_rank().over(Window.partitionBy("slot").orderBy("val")) - 1).alias("d"))
    sizes = dense.groupBy("slot").agg(F.count("*").alias("size"))
    base = sizes.select("slot", F.coalesce(F.sum("size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy()).alias("all"))
    tokens = packed.select("item", F.posexplode("p").alias("slot", "val")).join(dense, ["slot", "val"]).join(F.broadcast(base), "slot")
    per = tokens.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", (F.col("base") + F.col("d")).alias("t")))), lambda x: x["t"]).alias("codes"), F.max("all").alias("all"))
    return collision_ordinal(per, "codes").select("item", F.array_append("codes", F.col("all") + F.col("ordinal")).alias("value"))


def collision_stats(codes: DataFrame, code: str = "codes") -> DataFrame:
    groups = codes.groupBy(code).agg(F.count("*").alias("c"))
    return groups.agg(
        F.sum("c").alias("items"), F.count("*").alias("unique_codes"), (1 - F.count("*") / F.sum("c")).alias("collision_rate"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("collided_ratio"),
        F.sum((F.col("c") > 1).cast("long")).alias("collision_groups"), F.max("c").alias("max_collision"),
    )


def slot_quality(codes: DataFrame, config_sizes: list[int] | None = None, code: str = "codes") -> DataFrame:
    """slot, size (largest of config and observed + 1), used, entropy (divided by ln size), dead ratio."""
    long = codes.select(F.posexplode(code).alias("slot", "val")).groupBy("slot", "val").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("slot"))
    p = long.withColumn("p", F.col("c") / total)
    size = F.max("val") + 1
    if config_sizes:
        size = F.greatest(size, F.element_at(F.array(*map(F.lit, config_sizes)), F.first("slot") + 1))
    out = p.groupBy("slot").agg(size.alias("size"), F.count("*").alias("used"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    return out.select("slot", "size", "used", F.coalesce(F.try_divide("h", F.ln("size")), F.lit(0.0)).alias("entropy"), (1 - F.col("used") / F.col("size")).alias("dead"))


def trie(codes: DataFrame, code: str = "codes") -> DataFrame:
    """prefix, next: every prefix (the empty one too) and a code that may follow."""
    at = F.sequence(F.lit(0), F.size(code) - 1)
    steps = F.transform(at, lambda i: F.struct(F.slice(code, F.lit(1), i).alias("prefix"), F.get(F.col(code), i).alias("next")))
    return codes.where(F.size(code) > 0).select(F.explode(steps).alias("s")).select("s.*").distinct()


def pick_by_hash(codes: DataFrame, seed: int, code: str = "codes") -> DataFrame:
    """codes, item: of the items of equal codes the one at sha256("seed:codes")[:8] modulo their number, in id order."""
    key = F.array_join(F.transform(code, lambda x: x.cast("string")), ",")
    n = F.count("*").over(Window.partitionBy(code))
    at = F.row_number().over(Window.partitionBy(code).orderBy("item")) - 1
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long")
    return codes.select(code, "item", at.alias("at"), (number % n).alias("want")).where("at = want").drop("at", "want")
