"""Compiling histories into samples of bounded token length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import running


def vocabulary(items: DataFrame, item: str = "item", *order: str) -> DataFrame:
    """items with uid, dense from 0 in the given order (default: the id as text)."""
    keyed = items.withColumn("k_", F.col(order[0]) if order else F.col(item).cast("string"))
    return running(keyed, ["k_", *order[1:]], None, "uid").drop("k_")


def to_uids(histories: DataFrame, vocab: DataFrame, user: str = "user") -> DataFrame:
    """user, uids: known items in order; users without any go."""
    long = histories.select(user, F.posexplode("history").alias("pos", "item")).join(vocab.select("item", "uid"), "item")
    entry = F.array_sort(F.collect_list(F.struct("pos", "uid")))
    return long.groupBy(user).agg(F.transform(entry, lambda x: x["uid"]).alias("uids"))


def item_length(views: list[Column]) -> Column:
    """A marker and the payload of each representation (arrays: their size; null counts as one token)."""
    return sum((1 + v for v in views), F.lit(0))


def packed_length(lengths: Column, last: Column, separators: int) -> Column:
    """All items' lengths, the last one with its target views only, and separators between items."""
    n = F.size(lengths)
    body = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return body + last + separators * F.greatest(n - 1, F.lit(0))


def usable_suffix(long: DataFrame, budget: int, separators: int = 0, max_items: int | None = None, user: str = "user") -> DataFrame:
    """user, start, n_items, total: the longest suffix whose length fits the budget, of two items or more.

    long: user, pos, len (whole item), last_len (as last item). Lengths are positive, so the suffix sums from the end grow
    and the fitting rows are a suffix: one window over the user, one aggregation."""
    back = Window.partitionBy(user).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rn = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("pos")))
    own = F.when(F.col("rn_") == 1, F.col("last_len")).otherwise(F.col("len"))
    x = long.withColumn("rn_", rn).withColumn("total", F.sum(own).over(back) + separators * (F.col("rn_") - 1)).where(F.col("total") <= budget)
    if max_items:
        x = x.where(F.col("rn_") <= max_items)
    return x.groupBy(user).agg(F.min("pos").alias("start"), F.max("rn_").cast("long").alias("n_items"), F.max("total").cast("long").alias("total")).where("n_items >= 2")


def usable_history(long: DataFrame, target: DataFrame, budget: int, fixed: int, separators: int = 0, user: str = "user") -> DataFrame:
    """user, start, n_items, total for evaluation: history items before the target, within budget - fixed - target length.

    target: user, target_pos, target_len."""
    h = long.join(target, user).where(F.col("pos") < F.col("target_pos"))
    w = Window.partitionBy(user).orderBy(F.desc("pos"))
    x = h.withColumn("rn_", F.row_number().over(w))
    x = x.withColumn("total", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) + separators * F.col("rn_") + fixed + F.col("target_len")).where(F.col("total") <= budget)
    return x.groupBy(user).agg(F.min("pos").alias("start"), F.max("rn_").cast("long").alias("n_items"), F.max("total").cast("long").alias("total"))


def finetune_samples(histories: DataFrame, usable: DataFrame, user: str = "user") -> DataFrame:
    """user, sequence_uids, sequence_item_count, prediction_count, total_input_length."""
    s = histories.join(usable, user)
    n = F.size("uids")
    return s.select(user, F.slice("uids", F.col("start") + 1, F.greatest(n - F.col("start"), F.lit(1))).alias("sequence_uids"), "n_items", "total").select(
        user, "sequence_uids", F.col("n_items").alias("sequence_item_count"), (F.col("n_items") - 1).alias("prediction_count"), F.col("total").alias("total_input_length")
    )


def eval_samples(histories: DataFrame, usable: DataFrame, truths: str | None = None, user: str = "user") -> DataFrame:
    """user, history_uids, target_uid, ground_truth_uids, history_item_count, total_input_length, target_pos.

    Without truths the last item is the target and the rest its history; with them the whole sequence is the history and
    the first distinct truth the target."""
    s = histories.join(usable, user)
    n = F.size("uids")
    end = n if truths else n - 1
    want = F.array_distinct(truths) if truths else F.array(F.element_at("uids", -1))
    return s.select(
        user, F.slice("uids", F.col("start") + 1, F.greatest(end - F.col("start"), F.lit(0))).alias("history_uids"), F.get(want, F.lit(0)).alias("target_uid"), want.alias("ground_truth_uids"),
        F.col("n_items").alias("history_item_count"), F.col("total").alias("total_input_length"), end.cast("long").alias("target_pos"),
    )


def sample_statistics(samples: DataFrame, count: str, total: str) -> DataFrame:
    return samples.agg(F.count("*").alias("samples"), F.avg(count).alias("mean_items"), F.max(count).alias("max_items"), F.avg(total).alias("mean_length"), F.max(total).alias("max_length"), F.percentile(total, 0.5).alias("median_length"))


def roles(samples: DataFrame, user: str = "user") -> DataFrame:
    """user, position (from 1), item, role: how a sample uses its sequence. Before its history's span items are `skip`,
    then `hist`, the target `tgt`, what follows `tail`.

    samples: user, history, target_pos (from 0), history_items."""
    at = samples.select(user, "target_pos", "history_items", F.posexplode("history").alias("p", "item"))
    first = F.col("target_pos") - F.col("history_items")
    role = F.when(F.col("p") < first, "skip").when(F.col("p") < F.col("target_pos"), "hist").when(F.col("p") == F.col("target_pos"), "tgt").otherwise("tail")
    return at.select(user, (F.col("p") + 1).alias("position"), "item", role.alias("role"))


def by_length(samples: DataFrame, total: str = "total_input_length", user: str = "user") -> DataFrame:
    """Longest first: a sort for a sink, not for further operators."""
    return samples.orderBy(F.desc(total), user)
