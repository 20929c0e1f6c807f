"""Two-level ranks, running totals and percentiles, codes by projections, and checks that need no tables."""

import random

import numpy as np
import pytest

from histria import specs
from histria.operators import blocks, clustering, cooccurrence, order, samples, sequences, splits, vectors
from pyspark.sql import functions as F


def test_running_totals_in_both_directions(spark):
    r = random.Random(1)
    rows = [(r.choice([None, *range(40)]), i, r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, w long").repartition(5)
    for descending in (False, True):
        key = lambda x: ((x[0] is None, -(x[0] or 0)) if descending else (x[0] is not None, x[0] or 0), x[1])  # noqa: B023, E731
        at, total, want = 0, 0, {}
        for x in sorted(rows, key=key):
            want[x[1]] = (at, total)
            at, total = at + 1, total + x[2]
        got = order.running(df, ["k", "i"], None, "n", descending, buckets=7)
        assert {x["i"]: x["n"] for x in got.collect()} == {i: n for i, (n, _) in want.items()}
        got = order.running(df, ["k", "i"], "w", "t", descending, buckets=7)
        assert {x["i"]: x["t"] for x in got.collect()} == {i: t for i, (_, t) in want.items()}
    assert order.running(df.where("false"), ["k", "i"]).count() == 0


def test_percentiles_of_continuous_values(spark):
    x = np.random.default_rng(2).normal(size=501).round(2).tolist()
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    shares = [0.0, 0.1, 0.5, 0.937, 1.0]
    assert order.percentiles(df, F.col("v"), shares).first()["p"] == pytest.approx(np.quantile(x, shares).tolist())
    assert order.percentiles(df.where("false"), F.col("v"), [0.5]).first()["p"] == [None]


def test_average_ranks_and_auc_with_ties(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(30), r.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, s long, y boolean")
    less = lambda s: sum(x[1] < s for x in rows)
    same = lambda s: sum(x[1] == s for x in rows)
    got = {x["i"]: x["avg_rank"] for x in cooccurrence.average_rank(df, "s").collect()}
    assert got == {i: less(s) + (same(s) + 1) / 2 for i, s, _ in rows}
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in rows if a[2] for b in rows if not b[2]]
    assert cooccurrence.auc(df, "s", F.col("y")).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_segments_and_vocabularies_are_numbered_in_text_order(spark):
    h = spark.createDataFrame([(u, list(range(u % 7))) for u in range(120)], "user long, history array<int>")
    got = sequences.segment_records(h, 3, 1, "d", "s").orderBy("global_sequence_index").collect()
    want = [(u, k) for u in sorted(range(120), key=str) for k in range(-(-(u % 7) // 3))]
    assert [(x["source_uid"], x["segment_index"]) for x in got] == want and got[5]["uid"] == "d-s-00000005"
    v = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "item long, f long")
    assert [x["item"] for x in samples.vocabulary(v, "item", "f").orderBy("uid").collect()] == sorted(range(101), key=lambda i: i * 37 % 101)
    assert [x["item"] for x in samples.vocabulary(v).orderBy("uid").collect()] == sorted(range(101), key=str)


def test_hash_order_is_the_same_for_any_number_of_buckets(spark):
    df = spark.range(300).withColumnRenamed("id", "user")
    one, many = ({x["user"]: x["idx"] for x in splits.hash_order(df, "user", 5, n).collect()} for n in (1, 4096))
    assert one == many and sorted(one.values()) == list(range(300))
    with pytest.raises(ValueError):
        splits.randbelow(1, 0, 0)


def test_codes_by_projection(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.1, (40, 6)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")
    planes = np.random.default_rng(0).standard_normal((5, 6))
    got = {y["item"]: y["bits"] for y in clustering.gaussian_codes(df, 5).collect()}
    assert [got[i] for i in range(120)] == (x @ planes.T > 0).astype(int).tolist()
    centred = x - x.mean(0)
    first = np.linalg.svd(centred, full_matrices=False)[2][:2]
    codes = np.array([y["bits"] for y in clustering.pca_codes(df, 2).orderBy("item").collect()])
    for k in range(2):  # a component's sign is free
        side = (centred @ first[k] > 0).astype(int)
        assert (codes[:, k] == side).all() or (codes[:, k] == 1 - side).all()
    loss = lambda z: float(((np.where(z > 0, 1, -1) - z) ** 2).sum())
    turned = np.array([y["bits"] for y in clustering.rotated_codes(df, 2).orderBy("item").collect()])
    p = centred @ first.T
    best = min(loss(p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])) for a in np.linspace(0, np.pi / 2, 400))
    assert turned.shape == (120, 2) and len({tuple(t) for t in turned[:40].tolist()}) <= 2 and best <= loss(p)


def test_pooling_edges(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, None, None)], "i long, h array<array<double>>, m array<int>")
    got = {r["i"]: r for r in df.select("i", *[vectors.pool_tokens(F.col("h"), F.col("m"), k).alias(k) for k in ("mean", "cls", "last")]).collect()}
    assert (got[1]["mean"], got[1]["cls"], got[1]["last"]) == ([2.0, 3.0], [1.0, 2.0], [3.0, 4.0])
    assert (got[2]["mean"], got[2]["last"], got[3]["mean"], got[3]["cls"]) == (None, [1.0, 2.0], None, None)
    with pytest.raises(ValueError):
        vectors.pool_tokens(F.col("h"), F.col("m"), "max")


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    x = np.random.default_rng(6).normal(size=(60, 4)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")
    got = {}
    for r in blocks.exact_neighbors(df.where("item < 20"), df, 5, 6).orderBy("anchor", "rank").collect():
        got.setdefault(r["anchor"], []).append(r["item"])
    s = (x @ x.T).round(6)
    assert got == {i: sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:5] for i in range(20)}


def test_representation_graph():
    kinds = {"Codes": "sid", "more": "sid", "id": "uid", "title": "text", "body": "text", "spare": "hash"}
    got = specs.representation_graph(kinds, ["codes", "id", "title"], ["codes", "id"])
    assert got == {"representations": {"codes": "sid", "id": "uid", "title": "text"}, "encoder": ["codes", "id", "title"], "targets": ["codes", "id"]}
    for encoder, targets in ((["codes"], []), (["codes", "codes"], ["codes"]), (["x"], ["x"]), (["title", "codes"], ["codes"]), (["id", "codes"], ["id", "codes"]), (["codes", "title", "body"], ["codes"]), (["title", "codes"], ["title", "codes"])):
        with pytest.raises(ValueError):
            specs.representation_graph(kinds, encoder, targets)


def test_core_reads_a_written_table(spark, monkeypatch):
    """with `written` the raw rows are not written again, and the core is the same."""
    from histria.operators import sequences as S

    df = spark.createDataFrame([(u, [(u * i) % 7 for i in range(1, 9)]) for u in range(12)], "user long, history array<long>")
    kept, real = [], S.saved
    monkeypatch.setattr(S, "saved", lambda t: kept.append(t.columns) or real(t))
    rows = lambda w: sorted(map(tuple, S.n_core_fixpoint(df, 3, 5, 2, 2, written=w).histories.collect()))
    again = rows(False)
    assert ["user", "pos", "item"] in kept
    kept.clear()
    assert rows(True) == again and ["user", "pos", "item"] not in kept
