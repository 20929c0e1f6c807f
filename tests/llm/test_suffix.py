import hashlib
import random
from collections import Counter

import numpy as np

from histria.llm import suffix as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        m = np.cumsum(gone[:-1]) > 0
        out.append((d, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 205, 260, 600, 900)]
    rows = []
    for i in range(60):
        parts = [noise(r.randrange(0, 300))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) - 198))
            parts += [s[a:], noise(r.randrange(0, 150))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 1500), (103, "ab" * 300), (104, rows[3][1]), (4, rows[4][1]), (None, rows[5][1] + "x"), (105, "short"), (106, "short"), (107, noise(70_000))]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    for length, blocks, hot in ((200, S.BLOCK_BYTES, S.HOT), (120, 3000, S.HOT), (200, 3000, 3), (120, S.BLOCK_BYTES, 1)):
        got = S.remove_repeats(df, length, blocks, hot)
        assert sorted((tuple(x) for x in got.drop("spans").collect()), key=str) == brute(rows, length), (length, blocks, hot)


def test_passage_in_a_third_of_all_texts(spark):
    """One passage (its anchors are hot, and its edges differ in every text), a periodic text and an edge shared by few."""
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, edge = noise(500), noise(30)
    rows = [(i, noise(r.randrange(50, 400)) + (edge if i % 12 == 0 else "") + passage[r.randrange(40) :] + noise(r.randrange(300))) if i % 3 == 0 else (i, noise(r.randrange(100, 700))) for i in range(240)]
    rows += [(300 + i, noise(40 + i) + "na na. " * (100 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (S.HOT, 20, 4):
        assert sorted((tuple(x) for x in S.remove_repeats(df, 200, 20_000, hot).drop("spans").collect()), key=str) == brute(rows, 200), hot


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_difference_cover():
    for v in (16, 32, 64):
        c = S.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v)) and len(c) < 2.5 * v**0.5


def test_sort_block_marks_equal_strings():
    r = np.random.default_rng(2)
    rows = r.integers(0, 2, (40, 384)).astype(np.uint8)
    rows[7, 20:260] = rows[3, 20:260]
    rows[9] = rows[3]
    group = np.zeros(40, np.int64)
    got = S.sort_block(rows, group, np.zeros(40, int), np.full(40, 168), 200)
    want = np.zeros_like(got)
    for j in range(169):
        names = [x[j : j + 200].tobytes() for x in rows]
        want[:, j] = [names.count(x) > 1 for x in names]
    assert (got[:, :169] == want[:, :169]).all() and want.sum() > 2 * 169
