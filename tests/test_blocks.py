import numpy as np
import pytest

from histria.operators import blocks


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>")


def clustered(seed, groups=12, each=40, dims=8, spread=0.2):
    g = np.random.default_rng(seed)
    at = g.normal(size=(groups, dims)) * 4
    return np.concatenate([c + g.normal(size=(each, dims)) * spread for c in at]).round(2)


def want(x, ids, k):
    s = (x @ x.T).round(6)
    return {(i, r + 1): j for i in ids for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k])}


@pytest.mark.parametrize(("size", "k"), [(7, 5), (50, 60), (1000, 3)])
def test_neighbours_by_sorting(spark, monkeypatch, size, k):
    monkeypatch.setattr(blocks, "ANCHOR_ROWS", 6)
    x = clustered(1)
    x[100:180] = x[5]  # one vector many times over
    df = table(spark, x)
    got = blocks.neighbors(df.where("item % 16 = 0"), df, k, 6, size)
    assert {(r["anchor"], r["rank"]): r["item"] for r in got.rows.collect()} == want(x, range(0, len(x), 16), k)


def test_blocks_out_of_reach_are_not_met(spark):
    x = clustered(2, groups=20, each=50, spread=0.05)
    df = table(spark, x)
    got = blocks.neighbors(df.where("item % 10 = 0"), df, 5, 6, 25)
    assert {(r["anchor"], r["rank"]): r["item"] for r in got.rows.collect()} == want(x, range(0, len(x), 10), 5)
    assert got.met < got.pairs / 3
    g = np.random.default_rng(3)
    flat = table(spark, g.normal(size=(400, 8)))
    got = blocks.neighbors(flat.where("item % 40 = 0"), flat, 5, 6, 25)
    assert got.met <= got.pairs


def test_few_and_no_candidates(spark):
    df = table(spark, clustered(4, groups=1, each=4))
    assert blocks.neighbors(df, df, 10).rows.count() == 12
    assert blocks.neighbors(df, df.limit(0), 3).rows.count() == 0 and blocks.neighbors(df.limit(0), df, 3).rows.count() == 0


@pytest.mark.parametrize("size", [9, 500])
def test_ranks_by_sorting(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "ANCHOR_ROWS", 5)
    x = clustered(5, groups=9, each=30)
    x[40:90] = x[3]
    df = table(spark, x)
    pairs = [(i, j) for i in range(0, len(x), 13) for j in (i, (i + 7) % len(x), (i * i) % len(x), 3, 45, 10_000)]
    targets = spark.createDataFrame(pairs, "sample long, target long")
    got = {(r["sample"], r["target"]): r["rank"] for r in blocks.ranks(df.where("item % 13 = 0"), targets, df, 6, size).collect()}
    place = {(i, j): r for (i, r), j in want(x, range(0, len(x), 13), len(x)).items()}
    assert got == {p: place.get(p) for p in pairs}


def test_vectors_are_not_written_once_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "item long, v array<double>")
    written, saved = [], blocks.saved
    monkeypatch.setattr(blocks, "saved", lambda t: (written.append(set(t.columns)), saved(t))[1])
    assert blocks.neighbors(df, df, 3, 6, 10).rows.count() == 180
    assert written and not any({"a", "block"} <= columns for columns in written)
