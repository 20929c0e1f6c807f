"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from histria import specs
from histria.operators import catalog, codes, cooccurrence, frequency, profile, ranking, samples, sequences, splits, vectors


def hist(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"user {kind}, history array<{kind}>")


def test_common_prefix(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1, 2, 8, 9]), (2, [1, 7, 3, 4]), (3, [9, 2, 3, 4])], "item int, codes array<int>")
    base = F.array(*map(F.lit, [1, 2, 3, 4]))
    got = df.select("item", codes.common_prefix(base, F.col("codes")).alias("p"), codes.hamming(base, F.col("codes")).alias("h")).orderBy("item").collect()
    assert [r["p"] for r in got] == [4, 2, 1, 0]
    assert [r["h"] for r in got] == [0, 2, 1, 1]


def test_retrieval_metrics(spark):
    near = spark.createDataFrame([(2, 1, 0.9), (2, 3, 0.8), (2, 0, 0.1)], "anchor int, item int, score double")
    rel = spark.createDataFrame([(2, 1, 2.0), (2, 3, 1.0)], "anchor int, item int, rel double")
    r = cooccurrence.retrieval(cooccurrence.top_k(near, "anchor", "score", 2), rel, 2).first()
    assert (r["ndcg"], r["recall"], r["hit"]) == (1.0, 1.0, 1.0)


def test_retrieval_of_zero_relevance(spark):
    near = spark.createDataFrame([(2, 1, 0.9)], "anchor int, item int, score double")
    rel = spark.createDataFrame([(2, 1, 0.0)], "anchor int, item int, rel double")
    r = cooccurrence.retrieval(cooccurrence.top_k(near, "anchor", "score", 2), rel, 2).first()
    assert (r["ndcg"], r["recall"], r["hit"]) == (0.0, 1.0, 0.0)


def test_dataset_statistics(spark):
    h = hist(spark, [("u1", ["a", "b"]), ("u2", ["a", "c", "a"]), ("u3", ["d"])])
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    r = profile.dataset_statistics(h, items, 2).first()
    assert (r["interactions"], r["density_percent"], r["median_length"], r["cold_items"], r["cold_percent"], r["coverage_percent"]) == (6, 50.0, 2.0, 3, 75.0, 100.0)


def test_retention(spark):
    df = spark.createDataFrame([("alpha1", 1, 20), ("alpha99", 99, 80), ("beta1", 1, 25), ("beta99", 99, 100)], "data string, scale_percent int, observed_items int")
    assert {r["data"]: r["retention_percent"] for r in profile.retention(df).collect()} == {"alpha1": 25, "alpha99": 100, "beta1": 25, "beta99": 100}


def test_target_frequency(spark):
    df = hist(spark, [(1, [1, 2, 3]), (2, [1, 2, 2])], "int")
    assert {r["item"]: r["freq"] for r in frequency.target_frequency(df).collect()} == {2: 3, 3: 1}


def test_frequency_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 5, 6, 20, 21, 101)], "freq int")
    got = df.select("freq", frequency.frequency_bucket(F.col("freq"), [0, 5, 20, 100]).alias("b")).orderBy("freq").collect()
    assert [r["b"] for r in got] == ["0", "1-5", "1-5", "6-20", "6-20", "21-100", "101+"]


def test_breakdown_keeps_empty_buckets(spark):
    rec = spark.createDataFrame([(10, 1), (10, None), (20, 10)], "target int, rank int")
    freq = spark.createDataFrame([(10, 2), (20, 8)], "item int, freq int")
    got = {r["frequency_bucket"]: r for r in frequency.breakdown(rec, freq, [0, 5, 20, 100], [5, 10]).collect()}
    a, b = got["1-5"], got["6-20"]
    assert (a["n"], a["unique_targets"], a["hr5"], a["ndcg5"], a["mrr"]) == (2, 1, 0.5, 0.5, 0.5) and a["share"] == pytest.approx(2 / 3)
    assert (b["hr5"], b["hr10"]) == (0, 1) and b["ndcg10"] == pytest.approx(1 / math.log2(11))
    assert len(got) == 5 and got["0"]["n"] == 0 and got["101+"]["hr5"] is None


def test_transfer_deltas(spark):
    s = "item_id string, frequency int, frequency_bucket string, hr10 double, ndcg10 double, mrr double"
    uid = spark.createDataFrame([("a", 1, "1-5", 0.0, 0.0, 0.0), ("b", 2, "1-5", 0.0, 0.0, 0.0), ("c", 30, "21-100", 1.0, 1.0, 1.0), ("d", 40, "21-100", 1.0, 1.0, 1.0)], s)
    sid = spark.createDataFrame([("a", 1, "1-5", 0.0, 0.0, 0.0), ("b", 2, "1-5", 1.0, 1.0, 1.0), ("c", 30, "21-100", 0.0, 0.0, 0.0), ("d", 40, "21-100", 1.0, 1.0, 1.0)], s)
    tq = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.2), ("d", 0.8)], "item_id string, tq double")
    got = {(r["frequency_bucket"], r["quality"]): r["delta_hr10"] for r in frequency.transfer_summary(uid, sid, tq).collect()}
    assert got["1-5", "high"] == 1 and got["21-100", "low"] == -1


def test_thresholds(spark):
    rows = [("x", v) for v in (0.0, 0.1, 0.2, 0.3)] + [("y", v) for v in (10.0, 11.0, 12.0, 13.0)]
    df = spark.createDataFrame(rows, "b string, v double")
    assert {r["b"]: r["threshold"] for r in frequency.balanced_threshold(df, "v", "b").collect()} == {"x": 0.1, "y": 11.0}
    ties = spark.createDataFrame([("z", v) for v in (0.0,) * 4 + (0.5,) * 2 + (1.0,)], "b string, v double")
    assert frequency.balanced_threshold(ties, "v", "b").first()["threshold"] == 0.0
    same = spark.createDataFrame([("z", 0.0)] * 4, "b string, v double")
    assert frequency.balanced_threshold(same, "v", "b").count() == 0
    assert frequency.balanced_threshold(same, "v").count() == 0


def test_experiment_pairs(spark):
    e = spark.createDataFrame([("r1", "d", "m", "s", "uid+embedding"), ("r2", "d", "m", "s", "sid+embedding"), ("r3", "d", "m", "s", "sid")], "name string, data string, model string, source string, repr_type string")
    assert [tuple(r) for r in catalog.experiment_pairs(e).select("uid_name", "sid_name").collect()] == [("r1", "r2")]


def test_gate_and_fusion(spark):
    uid = spark.createDataFrame([("s", 0, -5.0), ("s", 1, 5.0)], "sample string, uid int, score double")
    sid = spark.createDataFrame([("s", 0, 5.0), ("s", 1, -5.0)], "sample string, uid int, score double")
    freq = spark.createDataFrame([(0, 0), (1, 100)], "uid int, freq int")
    got = ranking.fuse_two(uid, sid, freq).collect()
    assert len(got) == 2 and all(r["score"] > 0 for r in got)
    g = freq.select("uid", ranking.frequency_gate(F.col("freq"), 5, 0.5).alias("g")).orderBy("uid").collect()
    assert g[0]["g"] < 0.5 < g[1]["g"]


def test_fusion_floors_a_missing_side(spark):
    uid = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0)], "sample string, uid int, score double")
    sid = spark.createDataFrame([("s", 2, 7.0)], "sample string, uid int, score double")
    freq = spark.createDataFrame([], "uid int, freq int")
    got = {r["uid"]: r["score"] for r in ranking.fuse_two(uid, sid, freq, weight=0.5).collect()}
    assert got == {0: -1.0, 1: 0.0, 2: -1.0}


def test_fusion_of_a_sample_with_one_side(spark):
    uid = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0)], "sample string, uid int, score double")
    none = uid.limit(0)
    freq = spark.createDataFrame([(1, 500)], "uid int, freq int")
    g = 1 / (1 + math.exp(-(math.log1p(500) - math.log1p(5)) / 0.5))
    got = {r["uid"]: r["score"] for r in ranking.fuse_two(uid, none, freq).collect()}
    assert got[1] == pytest.approx(g * 1.0 - (1 - g)) and got[0] < got[1]
    assert [r["uid"] for r in ranking.fuse_two(uid, none, freq, limit=1).collect()] == [1]
    assert {r["uid"]: r["score"] for r in ranking.fuse_two(none, uid, freq, weight=0.5).collect()} == {0: -1.0, 1: 0.0}


def test_fusion_of_lists_of_which_one_is_empty(spark):
    lists = spark.createDataFrame([("s", 0, 1, 4.0), ("s", 0, 2, 8.0), ("t", 0, 1, 1.0), ("t", 1, 2, 1.0)], "sample string, list int, uid int, score double")
    got = {(r["sample"], r["uid"]): r["score"] for r in ranking.fuse_lists(lists, "minmax").collect()}
    assert got == {("s", 1): -0.5, ("s", 2): 0.0, ("t", 1): -0.5, ("t", 2): -0.5}
    assert {r["uid"]: r["score"] for r in ranking.fuse_lists(lists.where("sample = 's'"), "none", n_lists=1).collect()} == {1: 4.0, 2: 8.0}
    assert {r["uid"]: r["score"] for r in ranking.fuse_lists(lists.where("sample = 's'"), "none", n_lists=2).collect()} == {1: 1.5, 2: 3.5}


def test_candidates_of_lists_take_their_full_score(spark):
    full = spark.createDataFrame([("s", u, float(10 - u)) for u in range(6)], "sample string, uid int, score double")
    lists = spark.createDataFrame([("s", 0, 5, 2.0), ("s", 0, 4, 1.0), ("s", 0, 3, 0.0)], "sample string, list int, uid int, score double")
    freq = spark.createDataFrame([], "uid int, freq int")
    got = {r["uid"]: r["score"] for r in ranking.fuse_representations(full, lists, freq, 2, how="none", weight=0.5).collect()}
    assert got == {0: 5.0, 1: 4.5, 4: 3.5, 5: 3.5}  # the lists' floor is 0: the two best of the list, less 1


def neighbours(spark, items):
    return spark.createDataFrame([("q", x, i) for i, x in enumerate(items, 1)], "anchor string, item string, rank int")


def test_rank_ndcg(spark):
    ref = neighbours(spark, "abc")
    score = lambda t: vectors.rank_ndcg(ref, neighbours(spark, t), 3).first()["ndcg"]
    assert score("abc") == 1 and 0 < score("cba") < 1 and score("xbc") < score("cba")
    assert vectors.rank_ndcg(ref, neighbours(spark, "abc").where("false"), 3).count() == 0


def test_tail_of_short_histories(spark):
    df = hist(spark, [(1, list(range(300))), (2, [999]), (3, [0, 1, 2, 3, 4])], "int")
    got = {r["user"]: r["t"] for r in df.select("user", sequences.tail(F.col("history"), 256).alias("t")).collect()}
    assert got[1] == list(range(44, 300)) and got[2] == [999] and got[3] == [0, 1, 2, 3, 4]


def test_empty_histories_have_no_chunks(spark):
    df = hist(spark, [(1, []), (2, [1, 2, 3])], "int")
    got = sequences.chunks(df, 2, 1).collect()
    assert [(r["user"], r["segment"], r["history"]) for r in sorted(got, key=lambda r: r["segment"])] == [(2, 0, [1, 2]), (2, 1, [3])]


def test_latest_row_with_null_time_wins(spark):
    df = spark.createDataFrame([("u", None, 1), ("u", "2020-01-01", 5), ("v", "2020-01-01", 1), ("v", "2020-01-01", 2)], "user string, time string, n int")
    assert {r["user"]: r["n"] for r in sequences.latest_per_user(df, "user", "time", "n").collect()} == {"u": 1, "v": 2}


def test_scale_points():
    assert splits.scale_points(10_000, [1, 10, 99]) == (9970, {1: 100, 10: 1000, 99: 9900})


def test_nested_scales_nest_and_share_a_test(spark):
    users = spark.range(1000).withColumnRenamed("id", "user")
    o = splits.hash_order(users, "user", 3)
    assert sorted(r["idx"] for r in o.collect()) == list(range(1000))
    rows = splits.nested_scales(o, 1000, [1, 10, 99]).collect()
    part = lambda s, n: {r["user"] for r in rows if r["scale_percent"] == s and r["split"] == n}
    assert len(part(10, "train")) == 100 and part(1, "train") < part(10, "train") < part(99, "train")
    assert len(part(10, "test")) == 3 and part(10, "test") == part(99, "test") and not part(99, "train") & part(99, "test")


def test_exact_shuffle_is_the_loop(spark):
    users = spark.createDataFrame([(f"u{i}",) for i in range(30)], "user string")
    names = sorted(f"u{i}" for i in range(30))
    want = [names[i] for i in splits.permutation(30, 42)]
    got = [r["user"] for r in splits.exact_shuffle(users, "user", 42).orderBy("idx").collect()]
    assert got == want and sorted(got) == names and got != names


def test_randbelow_range():
    seen = {splits.randbelow(1, 7, c) for c in range(200)}
    assert seen == set(range(7)) and splits.randbelow(1, 1, 0) == 0


def test_ratio_split_counts(spark):
    o = splits.hash_order(spark.range(100).withColumnRenamed("id", "user"), "user", 1)
    got = {r["split"]: r["count"] for r in splits.ratio_split(o, 100, 0.8).groupBy("split").count().collect()}
    assert got == {"finetune": 80, "valid": 4, "test": 16} and splits.finetune_count(2, 0.99) == 1


def test_fusion_of_vectors(spark):
    a = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "item string, v array<float>")
    b = spark.createDataFrame([("b", [0.0, 5.0]), ("a", [12.0, 0.0])], "item string, v array<float>")
    got = {r["item"]: r["v"] for r in vectors.fuse([(a, 1.0), (b, 1.0)]).collect()}
    h = math.sqrt(0.5)
    assert got["a"] == pytest.approx([0.6 * h, 0.8 * h, h, 0]) and got["b"] == pytest.approx([0, h, 0, h])


def test_mean_pool_and_flatten(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0], [2.0, 3.0]])], "i int, v array<array<double>>")
    got = {r["i"]: r["p"] for r in df.select("i", vectors.mean_pool(F.col("v")).alias("p")).collect()}
    assert got == {1: [2.0, 3.0], 2: [1.0, 2.0, 3.0]}
    rows = [(1, [None, [1.0, 2.0], [3.0, 4.0]]), (2, [None, [1.0], None, [2.0, None]]), (3, [None, None]), (4, None), (5, [[7.0], None]), (6, [[]]), (7, [])]
    df = spark.createDataFrame(rows, "i int, v array<array<double>>")
    got = {r["i"]: r["p"] for r in df.select("i", vectors.mean_pool(F.col("v")).alias("p")).collect()}
    assert got == {1: [2.0, 3.0], 2: [1.0, 2.0], 3: None, 4: None, 5: [7.0], 6: None, 7: None}


def test_zero_vector_normalises_to_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    assert df.select(vectors.l2_normalize(F.col("v")).alias("v")).first()["v"] == [0.0, 0.0]


def test_pack_bits(spark):
    df = spark.createDataFrame([([1, 0, 1, 1, 0, 1, 1],)], "b array<int>")
    assert df.select(codes.pack_bits(F.col("b"), 7).alias("p")).first()["p"] == [0b101, 0b101, 0b100]


def test_collision_order_is_by_text(spark):
    df = spark.createDataFrame([(9, [1]), (10, [1]), (3, [2])], "item int, codes array<int>")
    got = {r["item"]: r["value"] for r in codes.sid_view(df, 1, 4).collect()}
    assert got == {10: [1, 4], 9: [1, 5], 3: [2, 4]}


def test_trie_leaves_are_items(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, [0, 2]), (3, [1, 1])], "item int, codes array<int>")
    got = {(tuple(r["prefix"]), r["next"]) for r in codes.trie(df).collect()}
    assert got == {((), 0), ((), 1), ((0,), 1), ((0,), 2), ((1,), 1)}


def test_multi_target_metrics(spark):
    ranks = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 7, 1)], "sample int, uid int, rank int")
    truths = spark.createDataFrame([(1, [7, 9, 7]), (2, [5])], "sample int, uids array<int>")
    r = ranking.multi_target_metrics(ranks, truths, [5]).first()
    ideal = 1 + 1 / math.log2(3)
    assert (r["samples"], r["hr5"], r["recall5"], r["mrr"]) == (2, 0.5, 0.25, 0.25) and r["ndcg5"] == pytest.approx(1 / math.log2(3) / ideal / 2)


def test_usable_suffix_needs_two(spark):
    df = spark.createDataFrame([(1, p, 5, 2) for p in range(4)] + [(2, 0, 5, 2)], "user int, pos int, len int, last_len int")
    got = [tuple(r) for r in samples.usable_suffix(df, 13, 0).collect()]
    assert got == [(1, 1, 3, 12)]


def test_auc_of_ties_and_empty_side(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1)], "s double, y int")
    assert cooccurrence.auc(df, "s", F.col("y") == 1).first()["auc"] == 0.75
    assert cooccurrence.auc(df.where("y = 1"), "s", F.col("y") == 1).first()["auc"] is None


def test_n_core_reaches_its_fixed_point(spark):
    df = hist(spark, [(u, [1, 2, 3, 10 + u]) for u in range(5)] + [(9, [50, 51])], "int")
    got = sequences.n_core_fixpoint(df, 5, 3, 2).histories
    assert {r["user"]: r["history"] for r in got.collect()} == {u: [2, 3] for u in range(5)}


def test_patience(spark):
    df = spark.createDataFrame([("r", e, m) for e, m in enumerate((3.0, 2.0, 2.5, 1.0, 4.0))], "run string, epoch int, loss double")
    got = [(r["improved"], r["patience"]) for r in ranking.improvements(df, "run", "epoch", "loss", True).orderBy("epoch").collect()]
    assert got == [(True, 0), (True, 0), (False, 1), (True, 0), (False, 1)]


def test_parsers():
    assert specs.count_buckets("1/2/5-9/10+") == [(1, 1), (2, 2), (5, 9), (10, None)]
    assert specs.id_ranges("1,3-5,5-3,9") == [1, 3, 4, 5, 9]
    assert specs.frequency_boundaries("20,0,5,5") == [0, 5, 20]
    assert specs.ranking_ks(20) == [5, 10, 20] and specs.ranking_ks(7) == [5, 7]
    assert specs.compare_targets("a.x+b.y") == [("a", "x"), ("b", "y")]
    assert specs.level_sizes("auto", 1000, 2) == [10, 10] and specs.level_tops("3", 2) == [3, 3]
    assert [specs.scalar(x) for x in ("null", "True", "7", "1.5", "x")] == [None, True, 7, 1.5, "x"]
    assert specs.output_path("a/{data}.csv", "d") == "a/d.csv" and specs.output_path("r.csv", "d", True) == "r.d.csv"
    for bad in ("", "1-0"):
        with pytest.raises(ValueError):
            specs.count_buckets(bad)
    with pytest.raises(ValueError):
        specs.frequency_boundaries("5,20")


def test_alias_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "name string, alias string")
    assert {r["name"]: r["target"] for r in catalog.resolve_aliases(df).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None}


def test_alias_chains_of_any_length(spark):
    chain = [(i, i - 1 if i else None) for i in range(101)]
    rows = chain + [(200, 201), (201, 202), (202, 200), (300, 999), (301, 300), (400, 400)]
    got = {r["name"]: r["target"] for r in catalog.resolve_aliases(spark.createDataFrame(rows, "name long, alias long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **dict.fromkeys([200, 201, 202, 300, 301, 400])}
