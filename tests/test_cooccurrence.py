from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from histria.operators import cooccurrence, splits


def log(spark, rows):
    return spark.createDataFrame([(u, k, i) for u, h in rows for k, i in enumerate(h)], "user string, pos int, item long")


HISTORIES = [("hot", [(k * k + k // 3) % 17 for k in range(900)]), ("b", [1, 1, 2]), ("c", [5]), ("d", [3, 4, 3, 4, 3]), *[(f"u{k}", [(k + j * j) % 9 for j in range(k)]) for k in range(12)]]


@pytest.mark.parametrize(("window", "size"), [(1, 2), (3, 4), (3, 7), (5, 4096), (10, 3)])
def test_pairs_of_a_user_cut_into_ranges(spark, window, size):
    """One user holds most of all events."""
    unordered, ordered = Counter(), Counter()
    for _, h in HISTORIES:
        for i, a in enumerate(h):
            for j in range(max(0, i - window), min(len(h), i + window + 1)):
                if i != j:
                    ordered[a, h[j]] += 1
                    if a != h[j]:
                        unordered[min(a, h[j]), max(a, h[j])] += 1
    long = log(spark, HISTORIES)
    assert {(r["left"], r["right"]): r["cnt"] for r in cooccurrence.window_pairs(long, window, size=size).collect()} == dict(unordered)
    got = Counter((r["center"], r["context"]) for r in cooccurrence.skipgram_pairs(long, window, size=size).collect())
    assert got == ordered


def test_ranges_are_even(spark):
    cut = cooccurrence.in_ranges(log(spark, HISTORIES[:1]), 5, "user", True, 100)
    sizes = [r["count"] for r in cut.groupBy("user", "range_").count().collect()]
    assert max(sizes) <= 110


def draws_by_hand(counts, positives, n, seed, limit):
    line = [i for i, c in sorted(counts.items()) for _ in range(c)] or sorted(counts)
    out = []
    for a in range(limit):
        x, y = (line[splits.randbelow(seed, len(line), 2 * a + side)] for side in (0, 1))
        if len(out) < n and x != y and (min(x, y), max(x, y)) not in positives:
            out.append((min(x, y), max(x, y)))
    return sorted(out)


@pytest.mark.parametrize("counts", [{k: 1 + k * k for k in range(12)}, {1: 5000, 2: 1, 3: 1, 4: 2}, {k: 0 for k in range(7)}, {1: 3, 2: 0, 9: 4, 10: 1}])
def test_negatives_are_the_first_draws_that_stand(spark, counts, monkeypatch):
    monkeypatch.setattr(cooccurrence, "OPENED", 2)
    positives = {(0, 1), (2, 3), (1, 2)}
    table = spark.createDataFrame(list(counts.items()), "item long, cnt long")
    known = spark.createDataFrame(sorted(positives), "left long, right long")
    got = sorted(tuple(r) for r in cooccurrence.negative_pairs(table, known, 60, 3).collect())
    assert got == draws_by_hand(counts, positives, 60, 3, 3000)
    assert len(got) == (2 if max(counts.values()) == 5000 else 60)  # 3,000 attempts give no more


def test_negatives_end_with_the_attempts(spark):
    table = spark.createDataFrame([(1, 5), (2, 5)], "item long, cnt long")
    known = spark.createDataFrame([(1, 2)], "left long, right long")
    assert cooccurrence.negative_pairs(table, known, 10).count() == 0
    assert cooccurrence.negative_pairs(table.limit(0), known, 10).count() == 0
    assert cooccurrence.negative_pairs(table, known.limit(0), 10, attempts=12).count() < 10


def test_draws_follow_the_weights(spark):
    """Chi-square of 10 items at 9 degrees of freedom: above 33.7 once in 10,000 seeds."""
    counts = {k: 50 + 30 * k for k in range(10)}
    table = spark.createDataFrame(list(counts.items()), "item long, cnt long")
    n = 4000
    none = spark.createDataFrame([], "left long, right long")
    got = Counter(i for r in cooccurrence.negative_pairs(table, none, n, 11).collect() for i in (r["left"], r["right"]))
    share = {k: c / sum(counts.values()) for k, c in counts.items()}
    differ = 1 - sum(p * p for p in share.values())
    want = {k: 2 * n * p * (1 - p) / differ for k, p in share.items()}
    assert sum((got[k] - w) ** 2 / w for k, w in want.items()) < 33.7


def test_ppmi_of_a_log_deals_pairs_once(spark):
    from histria import plans
    from histria.operators import cooccurrence as O
    from tests.compare import DATA

    rng = np.random.default_rng(9)
    log = spark.createDataFrame([(u, p, int(i)) for u in range(12) for p, i in enumerate(rng.zipf(1.4, 30) % 15)], "user long, pos int, item long")
    counts = log.groupBy("item").agg(F.count("*").alias("cnt"))
    for least in (1, 10, 1000):
        want = {(r["left"], r["right"]): (r["cnt"], round(r["ppmi"], 9)) for r in O.ppmi(O.window_pairs(log, 3), counts, least).collect()}
        got = {(r["left"], r["right"]): (r["cnt"], round(r["ppmi"], 9)) for r in O.window_ppmi(log, counts, 3, least, size=7).collect()}
        assert got == want
    plan = plans.QUERIES["ppmi"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # Above the pairs stands the join with one row of totals, and nothing else.
    assert plan[: plan.index("explode")].count("Join") == 1


def test_negatives_of_few_draws_shuffle_only_drawn_pairs(spark, monkeypatch):
    """the drawn pairs are broadcast under the pairs' aggregation; many draws meet all pairs, with equal rows."""
    from histria.operators import cooccurrence as O

    counts = spark.createDataFrame([(i, 1 + i % 3) for i in range(30)], "item long, cnt long")
    long = spark.createDataFrame([(u, p, (u * 7 + p * p) % 30) for u in range(20) for p in range(8)], "user long, pos int, item long")
    few = [tuple(r) for r in O.negative_pairs(counts, O.window_pairs(long, 3), 50).collect()]
    monkeypatch.setattr(O, "FEW", 0)
    many = [tuple(r) for r in O.negative_pairs(counts, O.window_pairs(long, 3), 50).collect()]
    assert sorted(few) == sorted(many) and len(few) == 50
