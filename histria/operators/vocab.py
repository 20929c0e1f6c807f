"""Registry of token namespaces, marker tokens, and the codes a slot may take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def marker_tokens(names: list[str], targets: list[str], graph: bool = True) -> dict[str, str]:
    """Marker name -> token, in the order of their indices: each representation and target once; with several targets one
    more for the decoder. Without a graph a marker is the name in angle brackets."""
    order = list(dict.fromkeys([*names, *targets]))
    if graph and len(targets) > 1:
        order.append("decoder_" + "_".join(targets))
    return {n: f"<repr:{n}>" if graph else f"<{n}>" for n in order}


def slot_ranges(codes: DataFrame, slots: int, size: int, code: str = "codes") -> DataFrame:
    """slot, first, last: the tokens a slot of a code sequence may take. Slot s has [s size, (s + 1) size); the slot after the
    last one tells apart items of equal codes and has as many as the largest group of such items."""
    groups = codes.groupBy(code).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))  # one row
    at = groups.select("most", F.explode(F.sequence(F.lit(0), F.lit(slots))).alias("slot"))
    width = F.when(F.col("slot") < slots, F.lit(size)).otherwise(F.col("most"))
    return at.select("slot", (F.col("slot") * size).cast("long").alias("first"), (F.col("slot") * size + width - 1).cast("long").alias("last"))


def slot_codes(ranges: DataFrame) -> DataFrame:
    """slot, code: every allowed code, as beam_search() takes for its first column of choices."""
    return ranges.where("first <= last").select("slot", F.explode(F.sequence("first", "last")).alias("code"))


def registry(spark: SparkSession, items: DataFrame, codes: dict[str, tuple[DataFrame, int, int]], markers: dict[str, str]) -> DataFrame:
    """name, kind, size, slots, collision_size, collision_offset: one row a namespace. codes: name -> (item and codes, slots, size)."""
    cell = lambda v: F.lit(v).cast("long")
    row = lambda name, kind, size, slots=None, more=None, offset=None: (F.lit(name).alias("name"), F.lit(kind).alias("kind"), size.cast("long").alias("size"), cell(slots).alias("slots"), (cell(None) if more is None else more).alias("collision_size"), cell(offset).alias("collision_offset"))
    out = items.agg(F.count_distinct("item").alias("n")).select(*row("uid", "uid", F.col("n")))
    out = out.unionByName(spark.range(1).select(*row("special", "special", F.lit(len(markers)))))
    for name, (table, slots, size) in codes.items():
        last = slot_ranges(table, slots, size).where(F.col("slot") == slots)
        more = F.col("last") - F.col("first") + 1
        out = out.unionByName(last.select(*row(name, "sid", slots * size + more, slots + 1, more, slots * size)))
    return out
