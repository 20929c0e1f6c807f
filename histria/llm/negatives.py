"""Hard negatives by a vector-approximation file (operator 13).

Every row keeps one byte a dimension: the cell its component lies in. With the least and largest value of each cell an
anchor gets, from the bytes alone, a lower and an upper bound of its score with the row. Whole vectors are read for those
rows only that may still be among the ones wanted: the best of the anchor's label, then the best of other labels inside each
positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parts, small, table

CELLS = 256
#: Components (of rows chosen by a hash) the cells' limits are placed by. They decide how tight bounds are, never the result.
LIMIT_VALUES = 1 << 20
#: Largest number of rows, and of anchors, that meet in a task; and rows multiplied at once.
ROWS_A_TASK, ANCHORS_A_TASK, STEP = 1 << 20, 1024, 4096
POSITIVES, NEGATIVES = 5, 3
_PAIR = "a long, part int, rid long, low long, high long"


def usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """rid (one a row), vec_id, label, x: rows that take part, components floor(scale * component)."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & ~bad)
    x = F.transform(v, lambda c: F.floor(c * scale))
    return good.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), label.alias("label"), x.alias("x"))


def matrix(x: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column, shorter ones filled up with zeros."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    n = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    at = np.repeat(np.arange(len(n)), n)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def limits(rows: DataFrame, dims: int, values: int = LIMIT_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): least and largest value of each cell of each dimension, cells about equally full.

    What lies between comes from rows chosen by a hash, of about `values` components in all; the outer ends are those of all rows.
    """
    ends = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.min("c").alias("a"), F.max("c").alias("z"))  # one row a dimension
    least, most = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for d, a, z in ends.collect():
        least[d], most[d] = a, z
    short = rows.agg(F.min(F.size("x"))).first()[0] or 0
    least[short:], most[short:] = np.minimum(least[short:], 0), np.maximum(most[short:], 0)  # what is filled up
    some = rows.orderBy(F.xxhash64("rid"), "rid").limit(max(CELLS, values // dims)).select("x").toArrow()
    got = np.sort(matrix(some.column("x"), dims), axis=0)
    low = np.empty((dims, CELLS), np.int64)
    low[:, 0] = least
    low[:, 1:] = got[np.arange(1, CELLS) * len(got) // CELLS].T
    low = np.clip(np.maximum.accumulate(low, axis=1), least[:, None], most[:, None])
    high = np.concatenate([np.maximum(low[:, :-1], low[:, 1:] - 1), most[:, None]], axis=1)
    return low, high


def quantise(low: np.ndarray, dims: int) -> Callable:
    """rid, label and the row's cells, one byte a dimension: the last cell that begins at or below the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), dims)
            cell = np.empty(x.shape, np.uint8)
            for d in range(dims):
                cell[:, d] = np.searchsorted(low[d], x[:, d], "right") - 1
            packed = pa.Array.from_buffers(pa.binary(dims), len(x), [None, pa.py_buffer(np.ascontiguousarray(cell))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("label"), packed], ["rid", "label", "cells"])

    return run


def _bytes(cells: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, dims)


def bounds(anchors: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with a vector of these cells, exact integers.

    A cell's table entry is the sum and the difference of its ends; over them the bounds are (a . sum -+ |a| . difference) / 2.
    """
    dims = np.arange(low.shape[0])
    total, width = (low + high)[dims, cells], (high - low)[dims, cells]
    most = float(np.abs(anchors).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * 4 * max(1, len(dims))
    if most < 2**53:  # double precision is exact here
        a = anchors.astype(np.float64)
        mid, half = a @ total.T.astype(np.float64), np.abs(a) @ width.T.astype(np.float64)
        return ((mid - half) / 2).astype(np.int64), ((mid + half) / 2).astype(np.int64)
    if most >= 2**63:
        raise ValueError("scores do not fit a long")
    mid, half = anchors @ total.T, np.abs(anchors) @ width.T
    return (mid - half) // 2, (mid + half) // 2


def _top(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, in no order."""
    n = x.shape[1]
    return x if n <= k else np.partition(x, n - k, axis=1)[:, n - k :]


_NONE = np.iinfo(np.int64).min


def _scan(anchors: pa.Table, rows: pa.Table, low: np.ndarray, high: np.ndarray, wanted: Callable) -> pa.Table:
    """Rows that `wanted` keeps of each block: its floors (per anchor, or anchor and window) rise from step to step."""
    dims = low.shape[0]
    out = []
    if anchors.num_rows and rows.num_rows:
        x, ids = matrix(anchors.column("x"), dims), anchors.column("a").to_numpy()
        names = rows.column("rid").to_numpy()
        state: dict = {}
        for at in range(0, rows.num_rows, STEP):
            part = rows.slice(at, STEP)
            lb, ub = bounds(x, _bytes(part.column("cells"), dims), low, high)
            for k, i, j in wanted(anchors, part, ids, names[at : at + STEP], lb, ub, state):
                out.append((ids[i], np.full(len(i), k, np.int32), names[at + j], lb[i, j], ub[i, j]))
    schema = pa.schema([("a", pa.int64()), ("part", pa.int32()), ("rid", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()


def _raise_floor(state: dict, key, sure: np.ndarray, k: int) -> np.ndarray:
    """Keeps the k largest sure lower bounds seen so far an anchor; returns the k-th."""
    top = np.concatenate([state[key], _top(sure, k)], axis=1) if key in state else sure
    state[key] = top = _top(top, k)
    return top.min(axis=1) if top.shape[1] == k else np.full(len(top), _NONE)


def _same_label(k: int) -> Callable:
    """Rows of one label that may be among an anchor's k best other rows."""

    def wanted(anchors, part, ids, names, lb, ub, state):
        own = ids[:, None] == names[None, :]
        floor = _raise_floor(state, 0, np.where(own, _NONE, lb), k)
        i, j = np.nonzero(~own & (ub >= floor[:, None]))
        yield 0, i, j

    return wanted


def _windows(k: int) -> Callable:
    """Rows of other labels that may be among the k best inside a window; `lo` and `hi` are lists, an entry a positive."""

    def wanted(anchors, part, ids, names, lb, ub, state):
        los, his = anchors.column("lo").to_pylist(), anchors.column("hi").to_pylist()
        _, codes = np.unique(np.concatenate([anchors.column("label").to_numpy(), part.column("label").to_numpy()]), return_inverse=True)
        other = codes[: len(ids), None] != codes[None, len(ids) :]
        for p in range(max(map(len, los), default=0)):
            lo = np.array([v[p] if len(v) > p else 1 for v in los])[:, None]
            hi = np.array([v[p] if len(v) > p else 0 for v in his])[:, None]
            may = other & (lo <= hi) & (ub >= lo) & (lb <= hi)
            sure = may & (lb >= lo) & (ub <= hi)
            floor = _raise_floor(state, p, np.where(sure, lb, _NONE), k)
            i, j = np.nonzero(may & (ub >= floor[:, None]))
            yield p, i, j

    return wanted


def _dealt(anchors: DataFrame, rows: DataFrame, keys: list[str], low: np.ndarray, high: np.ndarray, wanted: Callable) -> DataFrame:
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda a, r: _scan(a, r, low, high, wanted), _PAIR)


def _survivors(pairs: DataFrame, k: int, sure: Column) -> DataFrame:
    """Pairs whose upper bound reaches the k-th largest sure lower bound over all blocks of (a, part)."""
    pairs = materialize(pairs, "bounds")
    w = Window.partitionBy("a", "part").orderBy(F.desc("low"), "rid")
    floor = pairs.where(sure).withColumn("i", F.row_number().over(w)).where(F.col("i") == k).select("a", "part", F.col("low").alias("floor"))
    return pairs.join(floor, ["a", "part"], "left").where("floor is null or high >= floor").select("a", "part", "rid")


def _exact(pairs: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs with score and vec_id: whole vectors of these pairs only."""
    product = F.aggregate(F.zip_with("ax", "x", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
    with_a = pairs.join(anchors.select("a", F.col("x").alias("ax")), "a")
    return with_a.join(rows.select("rid", "vec_id", "x"), "rid").select("a", "part", "rid", "vec_id", product.alias("score"))


def hard_negatives(
    vectors: DataFrame, label: Column | None = None, anchors_where: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = 50, high_pct: int = 95,
    scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rows_a_task: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor; higher first, ties by
    smaller id. An anchor's positives are its best `positives` other rows of its label; each gets the best `negatives`
    rows of other labels with low_pct * positive <= 100 * negative <= high_pct * positive.

    Rows with a null id, label or vector, or any null or non-finite component take no part. A shorter vector counts as
    filled up with zeros (an empty one scores 0). Repeated rows are rows of their own: the copy of an anchor can be its
    positive, and an anchor given twice is answered twice. No anchor, no positive or nothing in a window: no rows. Scores
    whose bounds do not fit a long raise. Other columns are not read. All comparisons are between integers, so the
    result does not depend on how rows are dealt.

    A label of any size is cut into blocks of at most about rows_a_task rows; each block of rows meets each block of 1,024
    anchors (for positives: of the same label) as bytes, in steps of 4,096 rows with a rising floor, and what is left is
    held once more against the floor over all blocks. Nothing is capped: rows that may belong stay, however many. Of rows
    equal in label and components only the positives + 1 with the smallest ids are candidates, which loses nothing: the
    others have the same score with every anchor and come later.
    """
    label = F.col(label_col) if label is None else label
    chosen = (F.col("vec_id") % 50 == 0) if anchors_where is None else anchors_where
    rows = materialize(usable(vectors, label, id_col, vec_col, scale), "vectors")
    total, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    dims = max(1, dims or 0)
    low, high = limits(rows, dims) if total else (np.zeros((dims, CELLS), np.int64),) * 2
    size = rows_a_task or max(8192, min(ROWS_A_TASK, -(-total // (4 * parts(rows)))))
    kind = dict(rows.dtypes)["label"]
    per = rows.groupBy("label").agg(F.count("*").alias("n"))
    cut = small(per.select("label", F.ceil(F.col("n") / size).cast("int").alias("cuts")), 32)
    # of equal vectors of one label only the first few by id can be among the best of any anchor
    copies = Window.partitionBy("label", "x").orderBy("vec_id", "rid")
    first = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives))
    file = first.select("rid", "label", "x").mapInArrow(quantise(low, dims), f"rid long, label {kind}, cells binary")
    file = materialize(file.join(cut, "label").withColumn("block", F.pmod(F.xxhash64("rid"), "cuts").cast("int")), "cells")
    picked = rows.where(chosen).select(F.col("rid").alias("a"), F.col("vec_id").alias("anchor_id"), "label", "x")
    n_anchors = picked.count()
    picked = materialize(picked.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(max(1, -(-n_anchors // ANCHORS_A_TASK)))).cast("int")), "anchors")

    # positives: blocks of the anchor's label
    groups = materialize(picked.select("label", "g").distinct(), "anchor-groups")
    left = picked.join(cut, "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    right = file.join(groups, "label")
    near = _dealt(left.select("label", "g", "block", "a", "x"), right.select("label", "g", "block", "rid", "cells"), ["label", "g", "block"], low, high, _same_label(positives))
    best = _exact(_survivors(near, positives, F.lit(True)), picked, rows)
    w = Window.partitionBy("a").orderBy(F.desc("score"), "vec_id", "rid")
    best = best.withColumn("part", (F.row_number().over(w) - 1).cast("int")).where(F.col("part") < positives)
    best = materialize(best.select("a", "part", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: each positive's window, blocks of all rows
    lo, hi = F.ceil(F.col("positive_score") * low_pct / F.lit(100).cast("decimal(3,0)")), F.floor(F.col("positive_score") * high_pct / F.lit(100).cast("decimal(3,0)"))
    windows = best.select("a", "part", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    lists = windows.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("part", "lo", "hi"))).alias("w"))  # `positives` entries at most
    asking = picked.join(lists, "a").select("a", "label", "g", "x", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    blocks = max(1, -(-total // size))
    n_groups = max(1, -(-n_anchors // ANCHORS_A_TASK))
    left = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = file.select("rid", "label", "cells", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    far = _dealt(left, right, ["g", "block"], low, high, _windows(negatives)).join(windows, ["a", "part"])
    far = _survivors(far, negatives, (F.col("low") >= F.col("lo")) & (F.col("high") <= F.col("hi")))
    scored = _exact(far, picked, rows).join(best, ["a", "part"])
    inside = scored.where((F.col("score") * 100 >= F.col("positive_score") * low_pct) & (F.col("score") * 100 <= F.col("positive_score") * high_pct))
    w = Window.partitionBy("a", "part").orderBy(F.desc("score"), "vec_id", "rid")
    out = inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives).join(picked.select("a", "anchor_id"), "a")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY score DESC, vec_id, s.r)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
