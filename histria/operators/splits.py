"""Deterministic orders, splits and nested scales."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import running
from .shared import saved


def randbelow(seed, upper: int, counter: int) -> int:
    """Unbiased number below `upper`: the first bytes of SHA-256 of `seed:counter:nonce`, big-endian, rejected above the largest multiple."""
    if upper <= 0:
        raise ValueError("upper must be positive")
    if upper == 1:
        return 0
    size = (upper.bit_length() + 7) // 8
    limit = (256**size // upper) * upper
    nonce = 0
    while True:
        got = int.from_bytes(hashlib.sha256(f"{seed}:{counter}:{nonce}".encode()).digest()[:size], "big")
        if got < limit:
            return got % upper
        nonce += 1


def permutation(n: int, seed) -> list[int]:
    """Fisher-Yates from the end by the plain loop: the order that `shuffle_order` gives as a table."""
    out = list(range(n))
    for counter, i in enumerate(range(n - 1, 0, -1)):
        j = randbelow(seed, i + 1, counter)
        out[i], out[j] = out[j], out[i]
    return out


def randbelow_column(seed, upper: Column, counter: Column, tries: int = 64) -> Column:
    """randbelow() of columns, for an upper bound below 2^56. A draw is rejected with a chance under a half; after `tries` rejections it raises."""
    size = F.ceil(F.length(F.bin(upper)) / 8).cast("int")
    limit = F.call_function("div", F.pow(F.lit(256.0), size).cast("long"), upper) * upper

    def draw(nonce: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), counter.cast("string"), nonce.cast("string")), 256)
        return F.conv(F.substr(digest, F.lit(1), 2 * size), 16, 10).cast("long")

    def unless_found(found: Column, nonce: Column) -> Column:
        return F.when(found.isNotNull(), found).otherwise(F.when(draw(nonce) < limit, draw(nonce) % upper))

    got = F.reduce(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("long"), unless_found)
    return F.coalesce(got, F.raise_error(F.lit("no draw was accepted")).cast("long"))


def swap_partners(spark: SparkSession, n: int, seed) -> DataFrame:
    """i, j for i = n - 1 .. 0: the swap of each step, drawn by its own counter n - 1 - i, so in any order and any task."""
    return spark.range(n).select(F.col("id").alias("i"), randbelow_column(seed, F.col("id") + 1, n - 1 - F.col("id")).alias("j"))


def shuffle_order(spark: SparkSession, n: int, seed) -> DataFrame:
    """idx, pos: the element at place idx after a Fisher-Yates shuffle is the one that was at place pos.

    Place i is settled by step i. What it gets lay at j before: j's own element, or what the last step k > i with the
    same j put there, which lay at k before step k. So with up(k) = the smallest i > k that has j = k, elements come down
    from the ends of chains k -> up(k) -> ..., and the chains, a few dozen links long at any n, are followed by
    pointer doubling: as many joins as their length has binary digits. Groups of equal j hold about ln(n / j) steps.
    """
    steps = saved(swap_partners(spark, n, seed))
    first = steps.where("i > j").groupBy(F.col("j").alias("k")).agg(F.min("i").alias("up"))
    chains = saved(first)
    while True:
        further = chains.select(F.col("k").alias("up"), F.col("up").alias("upper"))
        jumped = saved(chains.join(further, "up", "left").select("k", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
        chains = jumped.select("k", "up")
        if jumped.where("moved").isEmpty():
            break
    later = steps.select("i", "j", F.lead("i").over(Window.partitionBy("j").orderBy("i")).alias("k"))
    ends = later.join(chains, "k", "left")
    return ends.select(F.col("i").alias("idx"), F.coalesce("up", "k", "j").alias("pos"))


def exact_shuffle(rows: DataFrame, key: str, seed) -> DataFrame:
    """rows with idx: the place of their key in the Fisher-Yates order of the distinct keys sorted as text. Any number of
    keys: swaps are composed as tables, nothing is sequential. hash_order is cheaper where that very order is not asked for."""
    keys = rows.select(F.col(key).alias("key_")).distinct().withColumn("text_", F.col("key_").cast("string"))
    placed = saved(running(keys, ["text_"]).select("key_", F.col("before").alias("pos")))
    order = shuffle_order(rows.sparkSession, placed.count(), seed)
    return rows.join(placed.join(order, "pos").select(F.col("key_").alias(key), "idx"), key)


def hash_key(key: str, seed) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def hash_order(rows: DataFrame, key: str, seed, buckets: int = 256) -> DataFrame:
    """rows with idx (from 0): the place in the order of (sha256("seed:key"), key), in two levels.

    The hash's first four bytes give one of so many range buckets; their counts are summed, ranks are taken inside each."""
    h = rows.withColumn("h_", hash_key(key, seed)).withColumn("b_", F.expr(f"cast(conv(substring(h_, 1, 8), 16, 10) as bigint) * {buckets} div {1 << 32}"))
    counts = h.groupBy("b_").agg(F.count("*").alias("n_"))
    base = counts.select("b_", F.coalesce(F.sum("n_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    inside = Window.partitionBy("b_").orderBy("h_", F.col(key).cast("string"))
    return h.join(F.broadcast(base), "b_").withColumn("idx", F.col("base_") + F.row_number().over(inside) - 1).drop("h_", "b_", "base_")


def finetune_count(total: int, ratio: float) -> int:
    """int(total * ratio), leaving one row on each side where there are two or more."""
    n = int(total * ratio)
    return max(1, min(n, total - 1)) if total > 1 else total


def ratio_split(ordered: DataFrame, total: int, ratio: float, valid_ratio: float = 0.2) -> DataFrame:
    """ordered(idx) with split: the first int(n ratio) are finetune; of the rest, the first fifth (at least one) valid, the others test."""
    ft = finetune_count(total, ratio)
    v = max(1, int((total - ft) * valid_ratio)) if total > ft else 0
    return ordered.withColumn("split", F.when(F.col("idx") < ft, "finetune").when(F.col("idx") < ft + v, "valid").otherwise("test"))


def count_split(ordered: DataFrame, pool: int = 5000, finetune: int = 40000, valid_ratio: float = 0.2) -> DataFrame:
    """The first `pool` rows are valid (a fifth) and test, the next `finetune` rows finetune; others have no split and go."""
    v = max(1, int(pool * valid_ratio)) if pool else 0
    out = ordered.withColumn("split", F.when(F.col("idx") < v, "valid").when(F.col("idx") < pool, "test").when(F.col("idx") < pool + finetune, "finetune"))
    return out.where("split is not null")


def official_test_split(ordered: DataFrame, valid: int = 5000, finetune: int | None = 40000) -> DataFrame:
    """With a test set of its own: the first rows are valid, the next finetune (all the rest for None)."""
    out = ordered.withColumn("split", F.when(F.col("idx") < valid, "valid").when(F.lit(True) if finetune is None else F.col("idx") < valid + finetune, "finetune"))
    return out.where("split is not null")


def scale_points(total: int, scales: list[int], test_ratio: float = 0.003) -> tuple[int, dict[int, int]]:
    """(start of the shared test tail, rows of each scale in percent): int(n (1 - r)) kept inside 1..n-1, scales capped there."""
    start = int(total * (1 - test_ratio))
    start = max(1, min(start, total - 1)) if total > 1 else total
    return start, {s: min(int(total * s / 100), start) for s in scales}


def nested_scales(ordered: DataFrame, total: int, scales: list[int], test_ratio: float = 0.003) -> DataFrame:
    """ordered with scale and split: each scale is a prefix of one order and shares its tail as test."""
    start, limits = scale_points(total, scales, test_ratio)
    table = F.array(*[F.struct(F.lit(s).alias("scale_percent"), F.lit(n).alias("limit")) for s, n in limits.items()])
    out = ordered.withColumn("x", F.explode(table)).withColumn("split", F.when(F.col("idx") >= start, "test").when(F.col("idx") < F.col("x.limit"), "train"))
    return out.where("split is not null").select(*ordered.columns, F.col("x.scale_percent").alias("scale_percent"), "split")


POLICIES = ("ratio", "official", "counts")


def public_sets(users: DataFrame, policy: str, seed, key: str = "user", official: DataFrame | None = None, ratio: float = 0.8, pool: int = 5000, finetune: int = 40000, valid_ratio: float = 0.2, remaining_as_valid: bool = False, ordered: DataFrame | None = None) -> DataFrame:
    """users with split (finetune, valid, test) by a dataset's policy, over the users in exact_shuffle() order.

    `ratio`: the first share of all users is finetune, of the others a fifth valid and the rest test. `counts`: so many users
    make up valid and test, the next ones finetune. `official`: the test users are given, the first `pool` users are valid,
    the next ones finetune. With `ratio` the test users may be given too: then they are the test split, and of the users left
    over the valid part stays, or with remaining_as_valid all of them. ordered: the users in that order (with idx) already,
    for several policies over the same ones."""
    if policy not in POLICIES:
        raise ValueError(f"no split policy {policy}; there are {', '.join(POLICIES)}")
    if policy == "official" and official is None:
        raise ValueError("the policy needs test users")
    ordered = exact_shuffle(users, key, seed) if ordered is None else ordered
    if policy == "ratio":
        out = ratio_split(ordered, ordered.count(), ratio, valid_ratio)
        if official is not None:
            rest = F.when(F.col("split") == "test", F.lit("valid" if remaining_as_valid else None)).otherwise(F.col("split"))
            out = out.withColumn("split", rest).where("split is not null")
    elif policy == "official":
        out = official_test_split(ordered, pool, finetune)
    else:
        return count_split(ordered, pool, finetune, valid_ratio)
    return out if official is None else out.unionByName(official.withColumn("split", F.lit("test")), allowMissingColumns=True)


def hash_sample(rows: DataFrame, key: str, n: int, seed) -> DataFrame:
    """The first n rows of the hash order: a top-k with partial results, no full sort."""
    return rows.withColumn("h_", hash_key(key, seed)).orderBy("h_", key).limit(n).drop("h_")


def random_pairs(rows: DataFrame, key: str, n: int, seed) -> DataFrame:
    """id, a, b: n ordered pairs of different rows. Pair i takes places of the hash order: an unbiased draw below the number
    of rows by counter 2 i, and a step from it, drawn below that number less one by counter 2 i + 1."""
    o = saved(hash_order(rows.select(F.col(key).alias("key_")), "key_", seed).select("key_", "idx"))
    total = o.count()
    if total < 2:
        return o.select(F.col("idx").alias("id"), F.col("key_").alias("a"), F.col("key_").alias("b")).limit(0)
    i = randbelow_column(seed, F.lit(total), 2 * F.col("id"))
    step = randbelow_column(seed, F.lit(total - 1), 2 * F.col("id") + 1)
    draws = rows.sparkSession.range(n).select("id", i.alias("i"), step.alias("step")).withColumn("j", (F.col("i") + 1 + F.col("step")) % total)
    left, right = o.select(F.col("idx").alias("i"), F.col("key_").alias("a")), o.select(F.col("idx").alias("j"), F.col("key_").alias("b"))
    return draws.join(left, "i").join(right, "j").select("id", "a", "b")
