"""Ordered user histories: folding, aligning, cutting, n-core filtering.

Histories are (user, history ARRAY) frames; their long form is (user, pos, item) with pos from 0. Operators are lazy and
need one shuffle by user at most; membership tests are semi joins, which Spark broadcasts only under its size threshold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running
from .shared import dealt, saved


def fold(log: DataFrame, user: str, item: str, *order: str) -> DataFrame:
    """user, history: a user's items in the given order. The item itself is the last tie-break."""
    entry = F.struct(*order, F.col(item).alias("item_"))
    return log.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["item_"]).alias("history"))


def unfold(histories: DataFrame, user: str = "user", history: str = "history") -> DataFrame:
    return histories.select(user, F.posexplode(history).alias("pos", "item"))


def refold(long: DataFrame, user: str = "user") -> DataFrame:
    return fold(long, user, "item", "pos")


def align(histories: DataFrame, items: DataFrame, user: str = "user") -> DataFrame:
    """Keep history elements that occur in items(item), in order; histories without any are dropped."""
    return refold(unfold(histories, user).join(items.select("item").distinct(), "item", "left_semi"), user)


def tail(history: Column, k: int) -> Column:
    """The latest k elements; shorter histories whole (a negative slice would give nothing for them)."""
    return F.when(F.size(history) > k, F.slice(history, -k, k)).otherwise(history)


def head_or_tail(history: Column, k: int) -> Column:
    """First k elements for k > 0, the last -k for k < 0, all for 0."""
    return F.slice(history, 1, k) if k > 0 else tail(history, -k) if k < 0 else history


def length_limits(histories: DataFrame, longest: int, shortest: int) -> DataFrame:
    return histories.withColumn("history", tail(F.col("history"), longest)).where(F.size("history") >= shortest)


def chunks(histories: DataFrame, size: int, shortest: int, user: str = "user") -> DataFrame:
    """user, segment, history: consecutive pieces of at most `size`, without those below `shortest`."""
    n = F.size("history")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.slice("history", i * size + 1, F.lit(size)))
    return histories.where(n > 0).select(user, F.posexplode(pieces).alias("segment", "history")).where(F.size("history") >= shortest)


def filter_and_chunk(histories: DataFrame, items: DataFrame, size: int, shortest: int, user: str = "user") -> DataFrame:
    return chunks(align(histories, items, user), size, shortest, user)


def segment_records(histories: DataFrame, size: int, shortest: int, name: str, split: str, user: str = "user") -> DataFrame:
    """Pieces with ids `{name}-{split}-{index:08d}`, numbered by (user, segment)."""
    cut = chunks(histories, size, shortest, user)
    counts = cut.groupBy(user).agg(F.count("*").alias("n"))
    first = running(counts.withColumn("name_", F.col(user).cast("string")), ["name_"], "n").select(user, "before")
    place = Window.partitionBy(user).orderBy("segment")
    out = cut.join(first, user).withColumn("global_sequence_index", F.col("before") + F.row_number().over(place) - 1)
    return out.select(
        synthetic_id(name, split, F.col("global_sequence_index")).alias("uid"), F.col(user).alias("source_uid"), F.col("segment").alias("segment_index"),
        F.size("history").alias("segment_length"), "global_sequence_index", "history",
    )


def synthetic_id(name: str, split: str, index: Column) -> Column:
    return F.concat(F.lit(f"{name}-{split}-"), F.lpad(index.cast("string"), 8, "0"))


def latest_valid(histories: DataFrame, items: DataFrame, k: int, shortest: int, user: str = "user") -> DataFrame:
    """The latest k elements among those in items: filtered before the cut, so that older ones fill the places."""
    return latest_of_long(unfold(histories, user), items, k, shortest, user)


def latest_of_long(long: DataFrame, items: DataFrame, k: int, shortest: int, user: str = "user", parts: int | None = None) -> DataFrame:
    """latest_valid() from (user, pos, item). parts: tasks for these rows, by default as the session has it."""
    valid = dealt(dealt(long, parts, "item").join(dealt(items.select("item"), parts, "item").distinct(), "item", "left_semi"), parts, user)
    recent = Window.partitionBy(user).orderBy(F.desc("pos"))
    kept = valid.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= k)
    return refold(kept, user).where(F.size("history") >= shortest)


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per non-null key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def latest_per_user(rows: DataFrame, user: str, time: str, *ties: str) -> DataFrame:
    """One row per user, the last by (time, ties). A null time sorts last, so it wins."""
    w = Window.partitionBy(user).orderBy(F.col(time).desc_nulls_first(), *[F.desc(c) for c in ties])
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def rating_label(rows: DataFrame, rating: str, above: float, inclusive: bool, truncate: bool = False) -> DataFrame:
    """label 1 for good ratings; the neutral 3 is dropped. truncate: ratings are cut to whole numbers first."""
    r = F.col(rating).cast("int") if truncate else F.col(rating)
    return rows.where(r != 3).withColumn("label", (r >= above if inclusive else r > above).cast("int"))


def positives(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.where(F.col(label) == 1)


def item_counts(histories: DataFrame) -> DataFrame:
    return histories.select(F.explode("history").alias("item")).groupBy("item").agg(F.count("*").alias("cnt"))


def n_core_rounds(histories: DataFrame, n: int, longest: int, shortest: int, rounds: int = 3, user: str = "user") -> DataFrame:
    """Cut to length, then `rounds` times: keep items of frequency n or more in the current histories, cut again.

    A round is one count (partial sums first) and one semi join; every round's result is a written checkpoint,
    so lineage stays short."""
    now = length_limits(histories, longest, shortest)
    for _ in range(rounds):
        core = item_counts(now).where(F.col("cnt") >= n).select("item")
        now = saved(length_limits(align(now, core, user), longest, shortest))
    return now


class Core(NamedTuple):
    histories: DataFrame
    items: DataFrame  # the allowed set the histories were built with
    rounds: int


def n_core_fixpoint(histories: DataFrame, n: int, longest: int, shortest: int, max_rounds: int | None = None, user: str = "user", allowed: DataFrame | None = None, written: bool = False, parts: int | None = None) -> Core:
    """Rebuild the latest valid histories from the raw ones with the current item set until that set stays the same.

    The first set is allowed(item), or all items. The set of a round is the items with frequency n or more in the rebuilt
    histories. Rounds may grow or shrink it; max_rounds ends the loop with one more rebuild. The raw (user, pos, item) rows
    are written once, or with `written` read from the histories, a table already; after the first round only users that have
    an item which came or went are rebuilt. parts: tasks for the raw rows, by default as the session has it.
    """
    long = unfold(histories, user) if written else saved(unfold(histories, user))
    items = saved((long if allowed is None else allowed).select("item").distinct())
    now = saved(latest_of_long(long, items, longest, shortest, user, parts))
    rounds = 0
    while True:
        rounds += 1
        new = saved(item_counts(now).where(F.col("cnt") >= n).select("item"))
        changed = saved(new.join(items, "item", "left_anti").unionByName(items.join(new, "item", "left_anti")))
        if changed.isEmpty():
            return Core(now, items, rounds)
        items = new
        touched = saved(long.join(changed, "item", "left_semi").select(user).distinct())
        rebuilt = latest_of_long(long.join(touched, user, "left_semi"), items, longest, shortest, user, parts)
        now = saved(now.join(touched, user, "left_anti").unionByName(rebuilt))
        if max_rounds is not None and rounds >= max_rounds:
            return Core(now, items, rounds)


def n_core_chunked(histories: DataFrame, n: int, size: int, shortest: int, rounds: int = 3, user: str = "user") -> DataFrame:
    """user, segment, history after `rounds` of: count over the segments, keep frequent items, cut into segments again."""
    now = chunks(histories, size, shortest, user)
    for _ in range(rounds):
        core = item_counts(now).where(F.col("cnt") >= n).select("item")
        key = F.struct(user, "segment").alias("key_")
        cut = filter_and_chunk(now.select(key, "history"), core, size, shortest, "key_")
        place = Window.partitionBy(user).orderBy("old", "part")
        now = cut.select(F.col(f"key_.{user}").alias(user), F.col("key_.segment").alias("old"), F.col("segment").alias("part"), "history")
        now = saved(now.select(user, (F.row_number().over(place) - 1).alias("segment"), "history"))
    return now


def public_items(splits: list[DataFrame], targets: str | None = None) -> DataFrame:
    """item: everything seen in a split's history or, if named, its extra target arrays."""
    seen = [s.select(F.explode("history").alias("item")) for s in splits]
    seen += [s.select(F.explode(targets).alias("item")) for s in splits if targets and targets in s.columns]
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out.distinct()


def targets(histories: DataFrame, answers: str | None = None, user: str = "user") -> DataFrame:
    """user, item: each answer if there are any, else the last history item."""
    last = F.array(F.try_element_at("history", F.lit(-1)))
    wanted = F.when(F.size(answers) > 0, F.col(answers)).otherwise(last) if answers else last
    return histories.where(F.size("history") > 0).select(user, F.explode(wanted).alias("item"))


def restricted(long: DataFrame, items: DataFrame, user: str = "user") -> DataFrame:
    """user, pos, item over the given items only, positions counted anew."""
    place = Window.partitionBy(user).orderBy("pos")
    kept = long.join(items.select("item").distinct(), "item", "left_semi")
    return kept.select(user, (F.row_number().over(place) - 1).alias("pos"), "item")


def require_all(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows restricted to keys; raises if a key is missing (total alignment)."""
    missing = keys.join(rows.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"no row for some {key}")
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated {', '.join(keys)}")
    return rows
