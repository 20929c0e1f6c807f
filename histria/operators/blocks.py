"""Exact neighbours and ranks over blocks of near vectors, of which those are skipped that bounds rule out.

Candidates go to the nearest of some pivots, large groups are cut up. For a block around pivot p with radius r an anchor's
scores lie within a . p -+ |a| r, so a block is met only where that could matter. What tasks run is defined inside functions:
workers need numpy and pyarrow, not this package.
"""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import dealt, saved

#: Vectors in a block, anchors that meet it in one task, and numbers of all pivots (they go to every task).
BLOCK_ROWS, ANCHOR_ROWS, PIVOT_VALUES = 4096, 8192, 2_000_000
#: Numbers of the vectors that one task of neighbors() holds of each side, at most.
WIDE_VALUES = 1 << 22
#: Vectors on each side of a tile of pairs(), of one that gives back its pairs computed, and at most of one that gives back
#: a few rows an anchor; such tiles a core at least; tasks at most; pairs that a task scores at once.
TILE_ROWS, EMIT_ROWS, FOLD_ROWS, TILES, MOST_TASKS, AT_ONCE = 1024, 2048, 8192, 6, 8192, 1 << 17
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}


class Blocks(NamedTuple):
    rows: DataFrame  # item, v, block
    pivots: np.ndarray  # one vector a block
    radius: np.ndarray
    count: np.ndarray
    kind: str


class Neighbors(NamedTuple):
    rows: DataFrame
    met: int  # pairs of an anchor and a block that were scored
    pairs: int  # all such pairs


def _numbers(rows: DataFrame) -> DataFrame:
    """v as doubles, or left as floats, which are written and sent in half the room and computed with as doubles."""
    return rows if dict(rows.dtypes)["v"] == "array<float>" else rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))


def blocked(candidates: DataFrame, size: int = BLOCK_ROWS) -> Blocks:
    """candidates(item, v) in blocks of about `size` vectors near to one another."""
    rows = saved(_numbers(candidates).select("item", "v"))
    kind, vector = dict(rows.dtypes)["item"], dict(rows.dtypes)["v"]
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 1)
    wanted = max(1, min(-(-n // size), PIVOT_VALUES // dims))
    some = rows.orderBy(F.xxhash64("item"), "item").limit(wanted).select("v").collect()
    pivots = np.array([r[0] for r in some], float).reshape(len(some), -1) if some else np.zeros((1, dims))

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            cell = np.empty(len(x), np.int64)
            for at in range(0, len(x), 1024):
                cell[at : at + 1024] = np.argmin((pivots * pivots).sum(axis=1)[None, :] - 2 * (x[at : at + 1024] @ pivots.T), axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("v"), pa.array(cell), pa.array(far)], ["item", "v", "cell", "far"])

    placed = saved(rows.mapInArrow(place, f"item {kind}, v {vector}, cell long, far double"))
    cells = sorted((r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect())  # one row a pivot at most
    table, first = [], 0
    for cell, m in cells:
        table.append((cell, first, -(-m // size)))
        first += table[-1][2]
    places = rows.sparkSession.createDataFrame(table, "cell long, first long, parts long")
    dealt = placed.join(F.broadcast(places), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("item"), "parts"))
    dealt = saved(dealt.select("item", "v", "block", "cell", "far"))
    radius, count, around = np.zeros(first), np.zeros(first, np.int64), np.zeros((first, pivots.shape[1]))
    for r in dealt.groupBy("block", "cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():
        radius[r["block"]], count[r["block"]], around[r["block"]] = r["r"], r["n"], pivots[r["cell"]]
    return Blocks(dealt.select("item", "v", "block"), around, radius, count, kind)


def _slack(digits: int | None):
    """What rounding may add to a score: of the arithmetic, and to so many digits."""
    return lambda size: 1e-9 * (1 + size) + (10.0**-digits if digits is not None else 0.0)


def _met(pairs: DataFrame, blocks: Blocks, kernel, schema: str, shelf: int = 1) -> DataFrame:
    """kernel(anchors, block rows) for each block, or shelf of so many blocks, and group of anchors that meet. pairs: block (or
    shelf), g and what the kernel reads. Of its own block a row has the number in `own`."""
    keys = pairs.select(F.col("block").alias("b_"), F.col("g").alias("g_")).distinct()
    rows = blocks.rows.select("item", "v", F.col("block").alias("own"), F.expr(f"block div {shelf}").alias("at_"))
    asked = rows.join(keys, F.col("at_") == F.col("b_")).select("item", "v", "own", F.col("b_").alias("block"), F.col("g_").alias("g"))
    return pairs.groupBy("block", "g").cogroup(asked.groupBy("block", "g")).applyInArrow(kernel, schema)


def wide(spark: SparkSession, anchors: int, candidates: int, dims: int, size: int) -> tuple[int, int]:
    """Blocks of a shelf, and groups of anchors: as wide as leaves every core some tasks, within WIDE_VALUES. A vector is sent
    once a shelf (or group of anchors) that it meets, so what is shuffled grows by the square over the width."""
    most = max(1, WIDE_VALUES // max(1, dims))
    side = min(most, math.isqrt(anchors * candidates // (TILES * spark.sparkContext.defaultParallelism)))
    return max(1, side // size), max(1, -(-anchors // max(min(ANCHOR_ROWS, most), side)))


def neighbors(anchors: DataFrame, candidates: DataFrame, k: int, digits: int | None = None, size: int = BLOCK_ROWS) -> Neighbors:
    """anchor, item, score, rank: the k candidates of largest inner product, the anchor itself left out, ties to the smaller item.

    An anchor first meets the blocks whose pivots score best, enough to hold k candidates; the k-th score found there is
    its floor. Then it meets those other blocks whose upper bound reaches the floor. Each meeting is a product of two
    matrices of bounded size; no pair of tables is crossed. Blocks stand in shelves: an anchor is sent once to a shelf, with
    the numbers of the blocks that it meets there, and the shelf gives back k rows an anchor.
    """
    b = blocked(candidates, size)
    asking = saved(_numbers(anchors).select(F.col("item").alias("anchor"), F.col("v").alias("a")))
    n = asking.count()
    kind, vector = dict(asking.dtypes)["anchor"], dict(asking.dtypes)["a"]
    shelf, groups = wide(anchors.sparkSession, n, int(b.count.sum()), b.pivots.shape[1], size)
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g")
    pivots, radius, count, slack = b.pivots, b.radius, b.count, _slack(digits)
    out = f"anchor {kind}, item {b.kind}, score double"
    if not len(count) or not n:
        empty = asking.select("anchor").limit(0).join(b.rows.select("item").limit(0), F.lit(True)).select("anchor", "item", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return Neighbors(empty, 0, 0)

    def choose(first: bool):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                a = batch.column("a").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                for at in range(0, len(a), 256):
                    part = a[at : at + 256]
                    near = part @ pivots.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    held = np.cumsum(count[order], axis=1)
                    early = np.zeros(near.shape, bool)
                    np.put_along_axis(early, order, np.c_[np.zeros((len(part), 1), np.int64), held[:, :-1]] < k + 1, axis=1)
                    if first:
                        i, j = np.nonzero(early)
                    else:
                        floor = batch.column("floor").to_numpy(zero_copy_only=False)[at : at + 256]
                        reach = np.linalg.norm(part, axis=1)[:, None] * radius[None, :]
                        upper = near + reach
                        i, j = np.nonzero(~early & ~(upper + slack(np.abs(near) + reach) < floor[:, None]))
                    first_of = np.flatnonzero(np.diff(i * len(count) + j // shelf, prepend=-1))
                    rows = pa.array(i[first_of] + at)
                    blocks = pa.ListArray.from_arrays(pa.array(np.append(first_of, len(j)).astype(np.int32)), pa.array(j.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column("anchor").take(rows), batch.column("a").take(rows), pa.array((j[first_of] // shelf).astype(np.int64)), blocks], ["anchor", "a", "block", "blocks"])

        return run

    def best(left, right):
        ids, items, own = left.column("anchor").to_numpy(), right.column("item").to_numpy(), right.column("own").to_numpy()
        order = np.lexsort((items, own))
        items, own = items[order], own[order]
        x = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(items), -1)[order]
        a = left.column("a").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        asked = left.column("blocks").combine_chunks()
        who, wanted = np.repeat(np.arange(len(ids)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        who, wanted = who[order], wanted[order]
        found = [(np.zeros(0, np.int64), items[:0], np.zeros(0))]
        for block in np.unique(own):
            here, to = (slice(*np.searchsorted(z, [block, block + 1])) for z in (own, wanted))
            y, its, mine = x[here], items[here], who[to]
            for at in range(0, len(mine), 256):
                r = mine[at : at + 256]
                s = a[r] @ y.T
                s = np.round(s, digits) if digits is not None else s
                s[ids[r, None] == its[None, :]] = -np.inf
                if s.shape[1] > k:
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                    above = s > kth
                    even = (s == kth) & (np.cumsum(s == kth, axis=1) <= k - above.sum(axis=1, keepdims=True))
                    i, j = np.nonzero((above | even) & (s > -np.inf))
                else:
                    i, j = np.nonzero(s > -np.inf)
                found.append((r[i], its[j], s[i, j]))
        r, its, s = (np.concatenate(c) for c in zip(*found, strict=True))
        if shelf > 1:  # of all blocks' best the shelf's
            order = np.lexsort((its, -s, r))
            r, its, s = r[order], its[order], s[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, its, s = r[kept], its[kept], s[kept]
        return pa.table([pa.array(ids[r]), pa.array(its), pa.array(s)], names=["anchor", "item", "score"])

    def kernel(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("anchor").slice(0, 0), right.column("item").slice(0, 0), pa.array([], pa.float64())], names=["anchor", "item", "score"])
        return best(left, right)

    pair = f"anchor {kind}, a {vector}, block long, blocks array<long>"
    # Vectors of anchors are not written once a block; what is counted holds none.
    early = asking.mapInArrow(choose(True), pair).withColumn("g", group)
    met = saved(_met(early, b, kernel, out, shelf))
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "item")
    floors = met.withColumn("i", F.row_number().over(w)).where(F.col("i") == k).select("anchor", F.col("score").alias("floor"))
    with_floor = asking.join(floors, "anchor", "left").select("anchor", "a", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    with_floor = saved(with_floor)
    late = with_floor.mapInArrow(choose(False), pair).withColumn("g", group)
    rows = met.unionByName(_met(late, b, kernel, out, shelf)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    pairs_met = early.select("blocks").unionByName(late.select("blocks")).agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    return Neighbors(rows, pairs_met, n * len(count))


def exact_neighbors(anchors: DataFrame, candidates: DataFrame, k: int, digits: int | None = None, blocks: int | None = None) -> DataFrame:
    """The rows of neighbors(), over at least so many blocks."""
    size = BLOCK_ROWS if blocks is None else max(1, min(BLOCK_ROWS, -(-candidates.count() // blocks)))
    return neighbors(anchors, candidates, k, digits, size).rows


def tiled(anchors: DataFrame, candidates: DataFrame, work, columns: dict[str, str], digits: int | None = None, size: int | None = None) -> DataFrame:
    """The rows that work(tile) makes, a dict of arrays by `columns` (name: type), over every pair of an anchor and a candidate.

    tile: ids of some anchors and items of the tile's candidates, both in order; score and pair, with a row an anchor (pair
    is False for the anchor itself); mine and theirs, Arrow tables of both sides' further columns; a, numbers by the anchors'
    further columns, where null is NaN.

    Both sides are dealt into groups of about `size`; a tile of two groups is one task's work, some anchors at a time. Only
    vectors are shuffled: each goes to as many tiles as the other side has groups. Tiles are dealt by their number into tasks
    of their own, whatever the session's partitions. Further columns are numbers; names differ between the sides."""
    size = size or TILE_ROWS
    n, m = anchors.count(), candidates.count()
    more_a, more_b = [c for c in anchors.columns if c not in ("item", "v")], [c for c in candidates.columns if c not in ("item", "v")]
    rows, cols = max(1, -(-n // size)), max(1, -(-m // size))
    tasks = min(rows * cols, MOST_TASKS)
    tiles = lambda own, other, k, l: [F.pmod(F.xxhash64("item"), F.lit(k)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(l - 1).cast("long"))).alias(other)]  # noqa: E731, E741
    left = anchors.select(F.col("item").alias("anchor"), F.col("v").alias("a"), *more_a, *tiles("i_", "j_", rows, cols))
    right = candidates.select(F.col("item").alias("candidate"), F.col("v").alias("b"), *more_b, *tiles("j_", "i_", cols, rows))
    left, right = (dealt(x, tasks, "i_", "j_").groupBy("i_", "j_") for x in (left, right))
    at_once = AT_ONCE
    kinds = [(c, _ARROW[k]) for c, k in columns.items()]

    def values(t, name, order):
        return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(order), -1)[order]

    def all_of(a, b):
        order, other = np.argsort(a.column("anchor").to_numpy(), kind="stable"), np.argsort(b.column("candidate").to_numpy(), kind="stable")
        x, y = values(a, "a", order), values(b, "b", other)
        ids, items = a.column("anchor").to_numpy()[order], b.column("candidate").to_numpy()[other]
        a, b = a.select(more_a).take(pa.array(order)), b.select(more_b).take(pa.array(other))
        numbers = {c: a.column(c).to_numpy() for c in more_a}
        step = max(1, min(128, at_once // len(items)))
        for at in range(0, len(ids), step):
            to = slice(at, at + step)
            score = x[to] @ y.T
            score = np.round(score, digits) if digits is not None else score
            mine = {c: v[to] for c, v in numbers.items()}
            out = work(SimpleNamespace(ids=ids[to], items=items, score=score, pair=ids[to, None] != items[None, :], mine=a.slice(at, step), theirs=b, a=mine))
            yield pa.table([out[c] if isinstance(out[c], (pa.Array, pa.ChunkedArray)) else pa.array(out[c], kind) for c, kind in kinds], names=[c for c, _ in kinds])

    def tile(a, b):
        # A side without rows comes without columns.
        out = list(all_of(a, b)) if a.num_rows and b.num_rows else []
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], kind) for c, kind in kinds})

    return left.cogroup(right).applyInArrow(tile, ", ".join(f"`{c}` {k}" for c, k in columns.items()))


def side(spark: SparkSession, anchors: int, candidates: int) -> int:
    """Vectors on each side of a tile that gives back a few rows an anchor: as many as leave every core some tiles, in bounds."""
    return max(TILE_ROWS, min(FOLD_ROWS, math.isqrt(anchors * candidates // (TILES * spark.sparkContext.defaultParallelism))))


def pairs(anchors: DataFrame, candidates: DataFrame, digits: int | None = None, size: int | None = None) -> DataFrame:
    """anchor, item, score (inner product) and the further columns of both sides, for every pair but an anchor with itself.

    Pairs go straight into what follows, so aggregate them by anchor (partial sums are taken in the tasks) rather than write
    or shuffle them; what can be computed by tiled() makes no row a pair."""
    kinds_a, kinds_b = dict(anchors.dtypes), dict(candidates.dtypes)
    more_a, more_b = [c for c in kinds_a if c not in ("item", "v")], [c for c in kinds_b if c not in ("item", "v")]

    def rows(t):
        i, j = np.nonzero(t.pair)
        return {"anchor": t.ids[i], "item": t.items[j], "score": t.score[i, j]} | {c: t.mine.column(c).take(pa.array(i)) for c in more_a} | {c: t.theirs.column(c).take(pa.array(j)) for c in more_b}

    columns = {"anchor": kinds_a["item"], "item": kinds_b["item"], "score": "double"} | {c: kinds_a[c] for c in more_a} | {c: kinds_b[c] for c in more_b}
    return tiled(anchors, candidates, rows, columns, digits, size)


def _off(mean: Column):
    """A part's squared deviations from the common mean."""
    return lambda p: F.when(p["n"] > 0, p["off"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean)).otherwise(0.0)


def pair_spread(anchors: DataFrame, candidates: DataFrame, lists, names: list[str], digits: int | None = None, size: int | None = None) -> DataFrame:
    """item and n_, mean_, dev_, low_, high_<name>: what ranking.spread() takes from the table of pairs, of which no row is made.

    lists(tile) gives for each name (mask, values): which pairs are in that list, and with what score. A tile gives back a
    row an anchor; deviations are joined around the common mean."""

    def parts(t):
        out = {"item": t.ids}
        for name, (mask, x) in lists(t).items():
            mask = np.broadcast_to(mask & t.pair, t.pair.shape)
            n = mask.sum(axis=1)
            mean = np.where(mask, x, 0.0).sum(axis=1) / np.maximum(n, 1)
            off = np.where(mask, x - mean[:, None], 0.0)
            out |= {f"n_{name}": n, f"mean_{name}": mean, f"off_{name}": np.einsum("ij,ij->i", off, off)}
            # NaN counts as the largest number, as in Spark.
            out |= {f"low_{name}": pa.array(np.fmin.reduce(np.where(mask, x, np.nan), axis=1), mask=n == 0), f"high_{name}": pa.array(np.maximum.reduce(np.where(mask, x, -np.inf), axis=1), mask=n == 0)}
        return out

    columns = {"item": dict(anchors.dtypes)["item"]}
    for name in names:
        columns |= {f"n_{name}": "bigint"} | {f"{part}_{name}": "double" for part in ("mean", "off", "low", "high")}
    per = tiled(anchors.select("item", "v"), candidates.select("item", "v"), parts, columns, digits, size).groupBy("item")
    wanted, shown = [], []
    for name in names:
        n, mean = F.col(f"n_{name}"), F.try_divide(F.col(f"sum_{name}"), F.col(f"n_{name}"))
        wanted += [F.sum(n).alias(f"n_{name}"), F.sum(n * F.col(f"mean_{name}")).alias(f"sum_{name}"), F.min(f"low_{name}").alias(f"low_{name}"), F.max(f"high_{name}").alias(f"high_{name}")]
        wanted.append(F.collect_list(F.struct(n.alias("n"), F.col(f"mean_{name}").alias("mean"), F.col(f"off_{name}").alias("off"))).alias(f"parts_{name}"))
        around = F.transform(f"parts_{name}", _off(mean))
        off = F.aggregate(around, F.lit(0.0), lambda s, x: s + x)
        shown += [f"n_{name}", mean.alias(f"mean_{name}"), F.sqrt(F.try_divide(off, n)).alias(f"dev_{name}"), f"low_{name}", f"high_{name}"]
    return per.agg(*wanted).select("item", *shown)


def ranks(samples: DataFrame, targets: DataFrame, candidates: DataFrame, digits: int | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """sample, target, rank: 1 + the candidates that come before the target by (score descending, item), the sample itself left
    out; null where the target is no candidate.

    samples: item, v. targets: sample, target. A block gives back the number of its better candidates for each target; one
    that bounds put wholly above or below a target's score is not met, and no table of scores is made.
    """
    b = blocked(candidates, size)
    pivots, radius, count, slack = b.pivots, b.radius, b.count, _slack(digits)
    wanted = targets.select("sample", "target").distinct()
    mine = b.rows.select(F.col("item").alias("target"), F.col("v").alias("t"))
    with_a = wanted.join(samples.select(F.col("item").alias("sample"), F.transform("v", lambda x: x.cast("double")).alias("a")), "sample")
    known = with_a.where("sample <> target").join(mine, "target")
    score = F.aggregate(F.zip_with("a", "t", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asking = saved(known.select("sample", "target", "a", (F.round(score, digits) if digits is not None else score).alias("score")))
    kinds = dict(asking.dtypes)

    def choose(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            t = batch.column("score").to_numpy(zero_copy_only=False)
            for at in range(0, len(a), 256):
                part = a[at : at + 256]
                near = part @ pivots.T
                reach = np.linalg.norm(part, axis=1)[:, None] * radius[None, :]
                free = slack(np.abs(near) + reach)
                here = t[at : at + 256, None]
                i, j = np.nonzero(near + reach + free >= here)
                above = (near - reach - free > here)[i, j]  # the sample itself may be among them: taken off below
                rows = pa.array(i + at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("sample", "target", "a", "score")), pa.array(j.astype(np.int64)), pa.array(np.where(above, count[j], -1))], ["sample", "target", "a", "score", "block", "whole"]
                )

    def better(left, right):
        names, wants = left.column("sample").to_numpy(), left.column("target").to_numpy()
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("sample").slice(0, 0), left.column("target").slice(0, 0), pa.array([], pa.int64())], names=["sample", "target", "n"])
        items = right.column("item").to_numpy()
        x = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
        a = left.column("a").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
        t = left.column("score").to_numpy()
        out = np.zeros(len(names), np.int64)
        for at in range(0, len(names), 256):
            to = slice(at, at + 256)
            s = a[to] @ x.T
            s = np.round(s, digits) if digits is not None else s
            ahead = (s > t[to, None]) | ((s == t[to, None]) & (items[None, :] < wants[to, None]))
            ahead &= (items[None, :] != names[to, None]) & (items[None, :] != wants[to, None])
            out[to] = ahead.sum(axis=1)
        return pa.table([left.column("sample"), left.column("target"), pa.array(out)], names=["sample", "target", "n"])

    pair = f"sample {kinds['sample']}, target {kinds['target']}, a array<double>, score double, block long, whole long"
    met = saved(asking.mapInArrow(choose, pair).withColumn("g", F.pmod(F.xxhash64("sample", "target"), F.lit(max(1, -(-asking.count() // ANCHOR_ROWS))))))
    counted = _met(met.where(F.col("whole") < 0).drop("whole"), b, better, f"sample {kinds['sample']}, target {kinds['target']}, n long")
    whole = met.where(F.col("whole") >= 0)
    own = whole.join(b.rows.select(F.col("item").alias("sample"), "block"), ["sample", "block"]).select("sample", "target", F.lit(-1).cast("long").alias("n"))
    total = counted.unionByName(whole.select("sample", "target", F.col("whole").alias("n"))).unionByName(own).groupBy("sample", "target").agg(F.sum("n").alias("n"))
    ranked = asking.join(total, ["sample", "target"], "left").select("sample", "target", (1 + F.coalesce("n", F.lit(0))).cast("int").alias("rank"))
    return targets.select("sample", "target").join(ranked, ["sample", "target"], "left")
