import hashlib
from collections import defaultdict

import numpy as np

from histria.operators import clustering


def by_hand(x, freq, sizes, iterations, scale):
    """path of each item, by Lloyd's iterations node by node."""
    fixed = {i: np.floor(np.abs(v) * scale + 0.5) * np.sign(v) for i, v in x.items()}
    paths = {i: () for i in x}
    for k in sizes:
        nodes = defaultdict(list)
        for i in sorted(paths):
            nodes[paths[i]].append(i)
        for path, items in nodes.items():
            if len(items) == 1 or k <= 1:
                groups = [items]
            elif len(items) <= k:
                groups = [[i] for i in sorted(items, key=lambda i: (-freq.get(i, 0), i))]
            else:
                first = sorted(items, key=lambda i: (hashlib.sha256(f"0:{i}".encode()).hexdigest(), i))[:k]
                centers = [fixed[i] for i in first]
                for t in range(iterations + 1):
                    got = defaultdict(list)
                    for i in items:
                        got[int(np.argmin([((fixed[i] - c) ** 2).sum() for c in centers]))].append(i)
                    if t < iterations:
                        centers = [np.mean([fixed[i] for i in got[c]], axis=0) for c in sorted(got)]
                groups = sorted(got.values(), key=lambda g: (-len(g), min(g)))
            for label, g in enumerate(groups):
                for i in g:
                    paths[i] = (*path, label)
    return paths


def vectors(spark, n, seed):
    g = np.random.default_rng(seed)
    at = g.normal(size=(7, 6)) * 3
    x = {i * 3: at[i % 7] + g.normal(size=6) for i in range(n)}
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "item long, v array<double>")


def test_levels_by_hand(spark):
    x, df = vectors(spark, 200, 1)
    freq = {i: i % 4 for i in x if i % 5}
    sizes = [6, 1, 30]
    nodes, leaves = clustering.hierarchy(df, spark.createDataFrame(list(freq.items()), "item long, freq long"), sizes, iterations=6)
    got = {r["item"]: r for r in leaves.collect()}
    want = by_hand(x, freq, sizes, 6, 1 << 20)
    assert {i: tuple(r["path"]) for i, r in got.items()} == want
    prefixes = sorted({p[:k] for p in want.values() for k in range(4)})
    number = {p: k for k, p in enumerate(prefixes)}
    assert all(r["node"] == number[want[i]] for i, r in got.items())
    table = {r["node"]: r for r in nodes.collect()}
    assert len(table) == len(prefixes)
    for p, k in number.items():
        assert table[k]["level"] == len(p) and (table[k]["parent"], table[k]["label"]) == ((number[p[:-1]], p[-1]) if p else (None, None))
    members = defaultdict(list)
    for i, p in want.items():
        members[p].append(i)
    for items in members.values():
        order = sorted(items, key=lambda i: (-freq.get(i, 0), i))
        assert [got[i]["leaf_label"] for i in order] == list(range(len(items)))


def test_jobs_grow_with_levels_not_nodes(spark):
    def jobs(name, k):
        spark.sparkContext.setJobGroup(name, name)
        _, df = vectors(spark, 240, 2)
        clustering.hierarchy(df, df.selectExpr("item", "1L AS freq"), [k, 4], iterations=2)[1].count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert abs(jobs("few", 2) - jobs("many", 40)) <= 12  # a fit a node would be several jobs for each of 38 more


def test_equal_vectors_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "item long, v array<double>")
    none = df.selectExpr("item", "1L AS freq").limit(0)
    leaves = clustering.hierarchy(df, none, [3])[1].collect()
    assert {tuple(r["path"]) for r in leaves} == {(0,)} and sorted(r["leaf_label"] for r in leaves) == list(range(9))
    nodes, leaves = clustering.hierarchy(df.limit(0), none, [3, 2])
    assert nodes.count() == 0 and leaves.count() == 0


def squared_error(x, back):
    return sum(float(((x[i] - np.array(back[i])) ** 2).sum()) for i in x)


def test_product_codes_beat_residual_codes_at_equal_bits(spark):
    """Parts of a vector that are independent: a code for each part says more than codes of the whole one after the other."""
    g = np.random.default_rng(5)
    centers = g.normal(size=(3, 4, 2)) * 4
    x = {i: np.concatenate([centers[p, g.integers(0, 4)] for p in range(3)]) + g.normal(size=6) * 0.1 for i in range(240)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "item long, v array<double>")
    codes = clustering.product_codes(df, 3, 8, 12).cache()
    assert {len(r["codes"]) for r in codes.collect()} == {3} and all(0 <= c < 8 for r in codes.collect() for c in r["codes"])
    back = {r["item"]: r["v"] for r in clustering.decode_product(codes, clustering.product_codebook(df, codes, 3)).collect()}
    residual = {r["item"]: r["codes"] for r in clustering.residual_codes(df, 3, 8).collect()}
    groups, left = {}, dict(x)
    for s in range(3):  # what residual codes give back: the means of what each slot's codes meet, added up
        groups = {c: np.mean([left[i] for i in left if residual[i][s] == c], axis=0) for c in {residual[i][s] for i in left}}
        left = {i: left[i] - groups[residual[i][s]] for i in left}
    assert squared_error(x, back) < sum(float((v**2).sum()) for v in left.values())


def test_rotation_lowers_the_error_and_is_orthogonal(spark):
    g = np.random.default_rng(6)
    turn = np.linalg.qr(g.normal(size=(4, 4)))[0]
    x = {i: (g.normal(size=4) * [5, 5, 0.2, 0.2]) @ turn for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "item long, v array<double>")

    def error(codes, rotation):
        there = clustering.turned(df, rotation)
        back = {r["item"]: np.array(r["v"]) @ rotation.T for r in clustering.decode_product(codes, clustering.product_codebook(there, codes, 2)).collect()}
        return squared_error(x, back)

    codes, rotation = clustering.rotated_product_codes(df, 2, 6, rounds=3, iterations=6)
    assert np.allclose(rotation @ rotation.T, np.eye(4), atol=1e-9)
    assert error(codes, rotation) < error(clustering.product_codes(df, 2, 6, 6), np.eye(4))


def test_cross_products_are_sums_over_all_rows(spark):
    g = np.random.default_rng(7)
    x, y = g.normal(size=(50, 3)), g.normal(size=(50, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(5)
    assert np.allclose(clustering.cross_products(df, 3, 2), x.T @ y)
