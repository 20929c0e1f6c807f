"""Item co-occurrence within position windows, PPMI, relevance lists and pair scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import percentiles, running, running_sums
from .shared import dealt, saved
from .splits import randbelow_column


#: Positions of a user's history in one task's frame.
RANGE = 4096


def in_ranges(long: DataFrame, window: int, user: str, behind: bool, size: int) -> DataFrame:
    """long with range_ and own_: each row in its range of `size` positions, and as a neighbour in the range before (and,
    with behind, after) where a row within the window stands. A user of any length is cut into ranges."""
    block, at = F.floor(F.col("pos") / size).cast("long"), F.col("pos") % size
    places = [F.struct(block.alias("r"), F.lit(True).alias("own")), F.when((at < window) & (block > 0), F.struct((block - 1).alias("r"), F.lit(False).alias("own")))]
    if behind:
        places.append(F.when(at >= size - window, F.struct((block + 1).alias("r"), F.lit(False).alias("own"))))
    placed = long.withColumn("x_", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
    return placed.select(user, "pos", "item", F.col("x_.r").alias("range_"), F.col("x_.own").alias("own_"))


#: Groups of ranges in a task, so that tasks are about equally long.
GROUPS = 64


def _in_groups(cut: DataFrame, user: str, parts: int | None) -> tuple[DataFrame, list[str]]:
    """cut dealt by part_, groups of its ranges, into so many tasks; and the keys of its ranges' frames."""
    if not parts:
        return cut, [user, "range_"]
    return dealt(cut.withColumn("part_", F.pmod(F.xxhash64(user, "range_"), F.lit(GROUPS * parts))), parts, "part_"), ["part_", user, "range_"]


def _counted(near: DataFrame, keys: list[Column], names: list[str], parts: int | None, by: int = 2) -> DataFrame:
    """names, cnt: the rows of near by the keys, twice. With parts they are counted where they are made, by part_, and then
    dealt by the first two keys, or the first `by`: a frequent pair sends a row a group."""
    if not parts:
        return near.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg((2 * F.count("*")).alias("cnt"))
    made = near.select("part_", *[k.alias(n) for k, n in zip(keys, names)]).groupBy("part_", *names).agg(F.count("*").alias("n_"))
    return dealt(made.drop("part_"), parts, *names[:by]).groupBy(*names).agg((2 * F.sum("n_")).alias("cnt"))


def window_pairs(long: DataFrame, window: int, user: str = "user", size: int = RANGE, parts: int | None = None) -> DataFrame:
    """left < right, cnt: unordered pairs of different items at most `window` positions apart, counted from both centres.

    long: user, pos (from 0, without gaps), item. A frame over the next `window` rows inside ranges of positions that
    overlap by the window: one shuffle by (user, range), no self join, and no user is too long. parts: tasks for the pairs,
    by default as the session has it."""
    cut, frames = _in_groups(in_ranges(long, window, user, False, max(size, window)), user, parts)
    ahead = Window.partitionBy(*frames).orderBy("pos").rowsBetween(1, window)
    group = frames[:-2]
    near = cut.select(*group, "item", "own_", F.collect_list("item").over(ahead).alias("near")).where("own_")
    near = near.select(*group, "item", F.explode("near").alias("other")).where("item <> other")
    return _counted(near, [F.least("item", "other"), F.greatest("item", "other")], ["left", "right"], parts)


def window_ppmi(long: DataFrame, item_counts: DataFrame, window: int, min_freq: int, user: str = "user", size: int = RANGE, parts: int | None = None, by: int = 2) -> DataFrame:
    """left, right, cnt, ppmi: ppmi() of window_pairs(), with its parts. by=1: all pairs of a left item lie in one task.

    Counts come to the log's rows, before pairs are made: only pairs of frequent items are shuffled, once, and no join
    deals them again. Their total is taken from the same frames, whose exchange is used twice."""
    ok = item_counts.where(F.col("cnt") >= min_freq).select("item", F.col("cnt").alias("n_"))
    known = long.select(user, "pos", "item").join(ok, "item", "left").select(user, "pos", F.struct("item", "n_").alias("item"))
    cut, frames = _in_groups(in_ranges(known, window, user, False, max(size, window)), user, parts)
    ahead = Window.partitionBy(*frames).orderBy("pos").rowsBetween(1, window)
    group = frames[:-2]
    near = cut.select(*group, "item", "own_", F.collect_list(F.when(F.col("item.n_").isNotNull(), F.col("item"))).over(ahead).alias("near")).where("own_ and item.n_ is not null")
    near = near.select(*group, "item", F.explode("near").alias("other")).where("item.item <> other.item")
    low, high = F.least("item", "other"), F.greatest("item", "other")  # structs compare by the item first
    keys = [low["item"], high["item"], low["n_"], high["n_"]]
    events, total = item_counts.agg(F.sum("cnt").alias("events")), near.agg((2 * F.count("*")).alias("total"))
    p = F.ln((F.col("cnt") / F.col("total")) / ((F.col("ci") / F.col("events")) * (F.col("cj") / F.col("events"))))
    counted = _counted(near, keys, ["left", "right", "ci", "cj"], parts, by)
    return counted.crossJoin(F.broadcast(events.crossJoin(total))).select("left", "right", "cnt", F.greatest(F.lit(0.0), p).alias("ppmi"))  # one row of totals


def skipgram_count(histories: DataFrame, window: int) -> DataFrame:
    """Ordered (centre, context) pairs within the window, by arithmetic on lengths alone."""
    n = F.size("history")
    per = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda a, i: a + F.least(F.lit(window), i) + F.least(F.lit(window), n - 1 - i))
    return histories.where(n > 0).agg(F.coalesce(F.sum(per), F.lit(0)).alias("pairs"))


def skipgram_pairs(long: DataFrame, window: int, user: str = "user", size: int = RANGE) -> DataFrame:
    """center, context: every ordered pair, repeats and equal items included. In ranges, as window_pairs()."""
    cut = in_ranges(long, window, user, True, max(size, 2 * window))
    w = Window.partitionBy(user, "range_").orderBy("pos")
    near = F.concat(F.collect_list("item").over(w.rowsBetween(-window, -1)), F.collect_list("item").over(w.rowsBetween(1, window)))
    return cut.select(F.col("item").alias("center"), "own_", near.alias("near")).where("own_").select("center", F.explode("near").alias("context"))


def ppmi(pairs: DataFrame, item_counts: DataFrame, min_freq: int) -> DataFrame:
    """left, right, cnt, ppmi for pairs of items with min_freq or more occurrences.

    max(0, ln(p_ij / (p_i p_j))): the pair total is taken after that filter, the item total before it."""
    events = item_counts.agg(F.sum("cnt").alias("events"))
    ok = item_counts.where(F.col("cnt") >= min_freq)
    a, b = ok.select(F.col("item").alias("left"), F.col("cnt").alias("ci")), ok.select(F.col("item").alias("right"), F.col("cnt").alias("cj"))
    kept = pairs.join(a, "left").join(b, "right")
    total = kept.agg(F.sum("cnt").alias("total"))
    p = F.ln((F.col("cnt") / F.col("total")) / ((F.col("ci") / F.col("events")) * (F.col("cj") / F.col("events"))))
    return kept.crossJoin(F.broadcast(events.crossJoin(total))).select("left", "right", "cnt", F.greatest(F.lit(0.0), p).alias("ppmi"))  # one row of totals


def relevance(edges: DataFrame, score: str) -> DataFrame:
    """anchor, item, rel: both directions of the undirected edges."""
    return edges.select(F.col("left").alias("anchor"), F.col("right").alias("item"), F.col(score).alias("rel")).unionByName(edges.select(F.col("right").alias("anchor"), F.col("left").alias("item"), F.col(score).alias("rel")))


def top_k(rows: DataFrame, group: str, score: str, k: int, tie: str = "item") -> DataFrame:
    """rank (from 1) of the k best rows of each group, ties to the smaller item."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Cells of the cumulative weights that one row is opened into at a time.
OPENED = 4096
#: Draws of a round, of two ids each, that a broadcast may hold.
FEW = 250_000


def weight_cells(item_counts: DataFrame) -> tuple[DataFrame, int, int]:
    """(cell, lo, hi, item; total; width): the items' weights laid end to end in item order, cut into as many equal cells as
    there are items. A number below the total lies in one cell, whose items it is compared with: as many as their
    weights go into the mean weight. A heavy item fills many cells, so numbers drawn for it meet many keys."""
    kept = saved(item_counts.select("item", F.col("cnt").cast("long").alias("cnt")))
    total, items = kept.agg(F.coalesce(F.sum("cnt"), F.lit(0)), F.count("*")).first()
    if not total:  # all weights 0: all items alike
        kept, total = kept.withColumn("cnt", F.lit(1).cast("long")), items
    width = max(1, -(-total // max(1, items)))
    laid = running(kept.where("cnt > 0"), ["item"], "cnt", "lo").select("item", "lo", (F.col("lo") + F.col("cnt")).alias("hi"))
    laid = laid.withColumn("first", F.expr(f"lo div {width}")).withColumn("last", F.expr(f"(hi - 1) div {width}"))
    some = laid.withColumn("part", F.explode(F.sequence(F.expr(f"first div {OPENED}"), F.expr(f"last div {OPENED}"))))
    cell = F.explode(F.sequence(F.greatest("first", F.col("part") * OPENED), F.least("last", F.col("part") * OPENED + OPENED - 1)))
    return saved(some.select(cell.alias("cell"), "lo", "hi", "item")), total, width


def negative_pairs(item_counts: DataFrame, positives: DataFrame, n: int, seed=0, attempts: int | None = None) -> DataFrame:
    """left, right: n pairs drawn by weight on both sides that are neither equal items nor positive pairs; pairs may repeat.

    Attempt a draws its sides by the unbiased numbers of counters 2 a and 2 a + 1. The first n attempts that stand are the
    result, whatever the partitioning; rounds of further attempts follow until there are n or `attempts` (default: 50 n, at
    least 1,000) are used up, and then fewer come back."""
    spark, limit = item_counts.sparkSession, attempts or max(50 * n, 1000)
    cells, total, width = weight_cells(item_counts)
    known = positives.select("left", "right").distinct()
    found, start = None, 0
    got = 0
    while got < n and start < limit and total:
        size = min(limit - start, int((n - got) * max(1.0, start / max(got, 1)) * 1.1) + 64)

        def side(name: str, which: int, start=start, size=size) -> DataFrame:
            x = spark.range(start, start + size).withColumn("x", randbelow_column(seed, F.lit(total), 2 * F.col("id") + which))
            met = x.withColumn("cell", F.expr(f"x div {width}")).join(cells, "cell").where("lo <= x AND x < hi")
            return met.select("id", F.col("item").alias(name))

        both = side("a", 0).join(side("b", 1), "id").where("a <> b").select("id", F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))
        if size <= FEW:  # then only those positive pairs are shuffled that were drawn
            both = saved(both)
            met = positives.select("left", "right").join(F.broadcast(both.select("left", "right").distinct()), ["left", "right"], "left_semi").distinct()
        else:
            met = known
        round_ = saved(both.join(met, ["left", "right"], "left_anti").select("id", "left", "right"))
        found = round_ if found is None else found.unionByName(round_)
        start, got = start + size, got + round_.count()
    if found is None:
        return item_counts.select(F.col("item").alias("left"), F.col("item").alias("right")).limit(0)
    return running(found, ["id"]).where(F.col("before") < n).select("left", "right")


def average_rank(rows: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """Average-method ranks from the table of distinct values."""
    by = running(rows.groupBy(value).agg(F.count("*").alias("m_")), [value], "m_", "before_")
    return rows.join(by.select(value, (F.col("before_") + (F.col("m_") + 1) / 2).alias(out)), value)


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with average ranks; null if a side is empty. Only the table of distinct scores is ordered."""
    by = running(rows.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("m")), [score], "m")
    r = by.select("p", "m", (F.col("before") + (F.col("m") + 1) / 2).alias("r"))
    one = r.agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").cast("double").alias("np"), F.sum(F.col("m") - F.col("p")).cast("double").alias("nn"))
    return one.select(F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def by_score(rows: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """keys, score, m, p, q: the rows of each score, its positive and its negative ones. Null counts as a score, as in auc()."""
    return rows.groupBy(*keys, score).agg(F.count("*").alias("m"), F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))


def score_summary(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    return summary_of(by_score(rows, score, positive), score)


def summary_of(by: DataFrame, score: str) -> DataFrame:
    """score_summary() from the table of distinct scores: ordered once for both medians and the AUC."""
    known = F.col(score).isNotNull()
    some = by.select(F.col(score).cast("double").alias("v_"), "m", "p", "q", *[F.when(known, F.col(c)).otherwise(0).alias(f"{c}_") for c in "pq"])
    placed = running_sums(some, ["v_"], {"before": "m", "lo_p": "p_", "lo_q": "q_"})
    placed = placed.crossJoin(F.broadcast(some.agg(*[F.coalesce(F.sum(f"{c}_"), F.lit(0)).alias(f"n_{c}") for c in "pq"])))  # one row of totals
    rank = F.col("before") + (F.col("m") + 1) / 2
    total = lambda c: F.sum(c).cast("double")
    wanted = [F.sum(F.col("p") * rank).alias("s"), total("p").alias("np"), total(F.col("m") - F.col("p")).alias("nn")]
    shown, medians = [], []
    for c, side in (("p", "positive"), ("q", "negative")):
        n, at = F.col(f"{c}_"), F.lit(0.5) * (F.col(f"n_{c}") - 1)
        holds = lambda place, c=c, n=n: (F.col(f"lo_{c}") <= place) & (place < F.col(f"lo_{c}") + n)
        wanted += [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"n_{side}"), F.sum(F.when(n > 0, F.col("v_") * n)).alias(f"sum_{side}")]
        wanted += [F.max(F.when(holds(F.floor(at)), F.col("v_"))).alias(f"low_{side}"), F.max(F.when(holds(F.ceil(at)), F.col("v_"))).alias(f"high_{side}"), F.max(at - F.floor(at)).alias(f"part_{side}")]
        between = F.col(f"low_{side}") + (F.col(f"high_{side}") - F.col(f"low_{side}")) * F.col(f"part_{side}")
        shown += [f"n_{side}", F.try_divide(f"sum_{side}", f"n_{side}").alias(f"mean_{side}")]
        medians.append(between.alias(f"median_{side}"))
    area = F.try_divide(F.col("s") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn"))
    return placed.agg(*wanted).select(*shown, *medians, area.alias("auc"))


def positive_rate_by_quantile(rows: DataFrame, score: str, positive: Column, bins: int) -> DataFrame:
    """bucket, low, high, n, rate: quantile buckets of the score with unique edges, left-closed, the last one closed."""
    edges = percentiles(rows, F.col(score), [i / bins for i in range(bins + 1)]).select(F.array_distinct("p").alias("e"))
    r = rows.select(F.col(score).alias("s"), positive.cast("double").alias("y")).crossJoin(F.broadcast(edges))  # one row of edges
    below = F.size(F.filter("e", lambda x: x <= F.col("s")))
    at = F.least(below, F.greatest(F.size("e") - 1, F.lit(1)))
    r = r.select("y", at.alias("bucket"), F.get("e", at - 1).alias("low"), F.coalesce(F.get("e", at), F.get("e", at - 1)).alias("high"))
    return r.groupBy("bucket", "low", "high").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


def retrieval(nearest: DataFrame, rel: DataFrame, k: int, items: DataFrame | None = None) -> DataFrame:
    """anchor, ndcg, recall, hit. nearest: anchor, item, rank (the k best by some score). rel: anchor, item, rel.
    items: the few items that occur in nearest at all, if so; then rel is cut to them before it is shuffled.

    An anchor whose relevances are all 0 has an ideal of 0 and so NDCG 0."""
    ideal = saved(top_k(rel, "anchor", "rel", k))  # k rows an anchor
    best = ideal.groupBy("anchor").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("ideal"), F.count("*").alias("n"))
    asked = nearest.where(F.col("rank") <= k)
    # Of rel only what an anchor asks for is shuffled where those items are few.
    if items is not None:
        rel = rel.join(F.broadcast(items), "item", "left_semi")
    known = asked.select("anchor", "item").join(rel, ["anchor", "item"])
    got = asked.join(known, ["anchor", "item"], "left").join(ideal.select("anchor", "item", F.lit(1).alias("top")), ["anchor", "item"], "left")
    per = got.groupBy("anchor").agg(F.sum(F.coalesce("rel", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("top").alias("found"), F.max(F.coalesce("rel", F.lit(0.0))).alias("most"))
    return best.join(per, "anchor", "left").select("anchor", F.coalesce(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))), F.lit(0.0)).alias("ndcg"), (F.coalesce("found", F.lit(0)) / F.greatest("n", F.lit(1))).alias("recall"), F.when(F.col("most") > 0, 1.0).otherwise(0.0).alias("hit"))
