import random
import re

import numpy as np

from histria.llm import jaccard as J


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    ids = [[d for (d, _), r in zip(rows, root) if r == c and d is not None] for c in root]
    same = [[d for (d, _), t in zip(rows, sets) if t == s and d is not None] if s else [d] for (d, _), s in zip(rows, sets)]
    kinds = {frozenset(s) for s in sets if s}
    links = [sum(100 * len(s & t) >= 75 * len(s | t) for t in kinds if t != s) if s else 0 for s in sets]
    least = lambda x: min((d for d in x if d is not None), default=None)
    return sorted(((d, len(s), least(x), least(y), n) for (d, _), s, x, y, n in zip(rows, sets, ids, same, links)), key=str)


def corpus(seed, groups=12):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    common = [r.choice(vocab) for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.randrange(3, 90))]
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join((common if r.random() < 0.4 else []) + t))
    return rows


EDGES = ["", None, "  \n ", "one two", "ONE two", "one two three four five", "a b c d", "a b c d", "x " * 5000, "x " * 4000]


def test_components_against_brute_force(spark):
    texts = corpus(1) + EDGES
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone in the world of words here"), (None, texts[0] + " one more"), (None, "z " + texts[5]), (0, texts[0]), (0, texts[-1])]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, n int")
    for tile, long_list in ((1200, 32), (4, 2)):
        got = sorted((tuple(r) for r in J.jaccard_components(df, tile=tile, long_list=long_list).collect()), key=str)
        assert got == brute(rows), (tile, long_list)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(3)
    for _ in range(300):
        base = r.integers(0, 1 << 62, 400).astype(np.uint64)
        a, b = np.unique(base[: r.integers(1, 400)]), np.unique(base[r.integers(0, 100) :])
        x, y = J.bitmap(a), J.bitmap(b)
        words = min(len(x), len(y))
        differ = int(np.bitwise_count(J.fold(x, words) ^ J.fold(y, words)).sum())
        assert differ <= len(np.setxor1d(a, b))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 75 * (len(a) + len(b) - inter):
            assert J.may_link(len(a), len(b), differ, 75)
            assert abs(J.band_of(np.array([len(a)]), 75)[0] - J.band_of(np.array([len(b)]), 75)[0]) <= J._BANDS + 1


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(2, 6) + ["", "", None]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = J.stage(spark, df, "").collect()
    want = {d for d, _, c, _, _ in brute(rows) if d == c}
    assert sorted(r["doc_id"] for r in kept) == sorted(want) and kept[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_stage_drops_rows_not_ids(spark):
    r = random.Random(6)
    say = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(30))
    a, b, c, d, e, f, g = (say() for _ in range(7))
    rows = [(2, a), (None, a + " x"), (None, b), (5, c), (5, a), (7, d), (7, d), (None, e), (None, e), (None, e + " y"), (None, f), (7, g), (None, ""), (None, ""), (9, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, digest int")
    kept = J.stage(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str)
    one = [x for x in got if x[1] in (e, e + " y")]
    assert len(one) == 1
    assert got == sorted([(2, a), (None, b), (5, c), (7, d), *one, (None, f), (7, g), (None, ""), (None, ""), (9, None)], key=str)
