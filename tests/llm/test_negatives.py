import numpy as np
import pytest
from pyspark.sql import functions as F

from histria.llm import negatives as N


def brute(rows, scale=256, k=5, m=3):
    """All rows of the result, by sorting all scores of every anchor."""
    good = []
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v):
            good.append((vec_id, label, [int(np.floor(scale * c)) for c in v]))
    out = []
    for i, (a, label, x) in enumerate(good):
        if a % 50:
            continue
        score = [sum(p * q for p, q in zip(x, y, strict=False)) for _, _, y in good]
        order = sorted((j for j in range(len(good)) if j != i), key=lambda j: (-score[j], good[j][0]))
        for j in [j for j in order if good[j][1] == label][:k]:
            p = score[j]
            inside = [n for n in order if good[n][1] != label and 50 * p <= 100 * score[n] <= 95 * p][:m]
            out += [(a, good[j][0], r + 1, good[n][0], p, score[n]) for r, n in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, x string, block int, score int")
    return sorted(tuple(r) for r in N.hard_negatives(df, **more).collect())


def some_rows(n, dims, seed):
    g = np.random.default_rng(seed)
    at = g.normal(size=(6, dims))
    return [(i * 5, (at[i % 6] + g.normal(size=dims) * 0.7).tolist(), int(g.integers(0, 4)) if i % 3 else 1) for i in range(n)]


@pytest.mark.parametrize("rows_a_task", [None, 37])
def test_brute_force(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(N, "STEP", 16)
    monkeypatch.setattr(N, "ANCHORS_A_TASK", 7)
    rows = some_rows(400, 9, 1)
    g = np.random.default_rng(2)
    rows += [(i * 5 + 2, rows[0][1], i % 2) for i in range(60)]  # one vector many times over
    rows += [(50 * i, [float(c) for c in g.integers(-2, 3, 9) / 256], i % 3) for i in range(50, 80)]  # many ties
    rows += [(100, rows[20][1], rows[20][2]), (100, rows[20][1], rows[20][2]), (7, [1.0, 2.0], 1), (50, [], 2), (13, [1e3] * 12, 0)]
    rows += [(None, [1.0] * 9, 1), (150, None, 1), (200, [1.0] * 8 + [None], 1), (250, [1.0] * 8 + [float("nan")], 1), (300, [float("inf")] * 9, 1), (350, [1.0] * 9, None)]
    got = run(spark, rows, rows_a_task=rows_a_task)
    assert len(got) > 100 and got == brute(rows)


def test_bounds_hold_and_are_tight_enough(spark):
    rows = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(some_rows(3000, 32, 3))], "vec_id long, embedding array<double>")
    kept = N.usable(rows.withColumn("label", F.lit(1)), F.col("label"), "vec_id", "embedding", 256)
    low, high = N.limits(kept, 32)
    x = N.matrix(kept.select("x").toArrow().column("x"), 32)
    cell = np.stack([np.searchsorted(low[d], x[:, d], "right") - 1 for d in range(32)], axis=1)
    d = np.arange(32)
    assert (low[d, cell] <= x).all() and (x <= high[d, cell]).all()
    lb, ub = N.bounds(x[:40], cell, low, high)
    exact = x[:40] @ x.T
    assert (lb <= exact).all() and (exact <= ub).all()
    assert np.median(ub - lb) < np.std(exact) / 2
    big = 2**14
    assert (N.bounds(x[:3] * big, cell, low * big, high * big)[0] <= exact[:3] * big * big).all()
    with pytest.raises(ValueError):
        N.bounds(x[:3] * 2**26, cell, low * 2**26, high * 2**26)


def test_few_rows_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [2.0], 2)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.5, 1.0], 2), (3, [1.5, -1.0], 2), (4, [0.9, 0.0], 3), (5, [1.91, 0.0], 3)]
    assert run(spark, rows) == brute(rows) and [r[3] for r in brute(rows)] == [2, 3]
    assert run(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [0.6], 2)]) == []  # a positive below zero has an empty window
