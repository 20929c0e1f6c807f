from collections import Counter

import pytest
from pyspark.sql import functions as F

from histria.operators import formatting, sequences, splits


@pytest.mark.parametrize(("n", "seed"), [(0, 1), (1, 1), (2, "s"), (257, 42), (3000, "RUN:v1")])
def test_shuffle_order_is_the_loop(spark, n, seed):
    got = {r["idx"]: r["pos"] for r in splits.shuffle_order(spark, n, seed).collect()}
    assert [got[i] for i in range(n)] == splits.permutation(n, seed) and len(got) == n


def test_draws_of_columns_are_the_helper(spark):
    uppers = [1, 2, 3, 127, 128, 129, 255, 256, 257, 65535, 65537, 2**24 + 1, 2**31 + 7, 2**40 + 3]
    df = spark.createDataFrame([(u, c) for u in uppers for c in range(40)], "u long, c long")
    for r in df.select("u", "c", splits.randbelow_column("x:y", F.col("u"), F.col("c")).alias("v")).collect():
        assert r["v"] == splits.randbelow("x:y", r["u"], r["c"])


def histories(spark, rows):
    return spark.createDataFrame(rows, "user string, history array<long>")


def core_by_hand(rows, allowed, n, longest, shortest, max_rounds):
    rounds = 0
    while True:
        now = {u: [i for i in h if i in allowed][-longest:] for u, h in rows}
        now = {u: h for u, h in now.items() if len(h) >= shortest}
        if max_rounds is not None and rounds >= max_rounds:
            return now, allowed, rounds
        count = Counter(i for h in now.values() for i in h)
        rounds += 1
        new = {i for i, c in count.items() if c >= n}
        if new == allowed:
            return now, allowed, rounds
        allowed = new


@pytest.mark.parametrize("max_rounds", [None, 1, 3])
def test_core_from_an_allowed_set(spark, max_rounds):
    rows = [(f"u{k}", [(k * j * j + 3 * j) % 23 for j in range(k % 13)]) for k in range(80)]
    allowed = set(range(2, 23)) | {99}
    got = sequences.n_core_fixpoint(histories(spark, rows), 9, 5, 2, max_rounds, allowed=spark.createDataFrame([(i,) for i in allowed], "item long"))
    now, items, rounds = core_by_hand(rows, allowed, 9, 5, 2, max_rounds)
    assert {r["user"]: r["history"] for r in got.histories.collect()} == now
    assert {r["item"] for r in got.items.collect()} == items and got.rounds == rounds


def test_full_mode_by_hand(spark):
    rows = [(f"u{k}", [(k + j * j) % 12 for j in range(1 + k % 9)]) for k in range(40)] + [("none", [])]
    captions, complete = set(range(11)), set(range(1, 12))
    table = lambda s: spark.createDataFrame([(i, f"c{i}") for i in s], "item long, caption string")
    got = formatting.full(histories(spark, rows), table(captions), table(complete), 4, 2, seed=7, test_ratio=0.2)
    stages, now = [rows], rows
    for allowed in (captions, complete, captions):
        now = [(u, [i for i in h if i in allowed][-4:]) for u, h in now]
        now = [(u, h) for u, h in now if len(h) >= 2]
        stages.append(now)
    assert [(s.rows, s.interactions) for s in got.stages] == [(len(x), sum(len(h) for _, h in x)) for x in stages]
    last = dict(now)
    names = sorted(last)
    order = [names[i] for i in splits.permutation(len(names), 7)]
    start = max(1, min(int(len(names) * (1 - 0.2)), len(names) - 1))
    want = {u: (last[u], k, "test" if k >= start else "train") for k, u in enumerate(order)}
    assert {r["user"]: (r["history"], r["idx"], r["split"]) for r in got.users.collect()} == want
    assert {r["item"] for r in got.items.collect()} == {i for h in last.values() for i in h}
    account = {r["stage"]: r for r in formatting.accounting(got.stages).collect()}
    assert account["raw"]["users"] == 41 and account["raw"]["min_length"] == 0
    assert account["aligned"]["items"] == len({i for h in last.values() for i in h})
    assert account["captions"]["removed_rows"] == len(stages[0]) - len(stages[1])


def test_latest_rows_keep_repeated_rows_apart(spark):
    rows = [("a", 1, 1, [1, 2, 9]), ("a", 2, 1, [9]), ("b", 1, 1, [3, 4, 5, 6]), ("b", 1, 1, [3, 4, 5, 6]), ("c", None, 1, [1, 2]), ("c", 5, 1, [2, 3]), ("d", 1, 1, [1])]
    raw = spark.createDataFrame(rows, "user string, time int, tie int, history array<long>")
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "item long")
    got = formatting.latest_rows(raw, items, "time", ["tie"], 3, 2, seed=1, test_ratio=0.5)
    assert [(s.rows, s.interactions) for s in got.stages] == [(7, 17), (7, 13), (4, 6), (2, 5)]
    assert {r["user"]: r["history"] for r in got.users.collect()} == {"b": [4, 5, 6], "c": [1, 2]}


def test_empty_log(spark):
    raw = histories(spark, [])
    items = spark.createDataFrame([(1,)], "item long")
    got = formatting.full(raw, items, items, 4, 2)
    assert got.users.count() == 0 and formatting.accounting(got.stages).where("rows > 0").count() == 0
