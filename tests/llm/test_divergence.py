import re
from collections import Counter, defaultdict

from histria.llm import divergence as D


def brute(rows, least, top):
    """(lang, source, part, item, value, rank) by plain loops, every term for every pair."""
    lower = str.maketrans(D.UPPER, D.UPPER.lower())
    docs = [((lang or ""), (source or ""), re.findall(D.TERM, (text or "").translate(lower))) for lang, source, text in rows]
    seen, count, groups = Counter(), Counter(), sorted({(a, b) for a, b, _ in docs})
    for lang, source, words in docs:
        seen.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    kept = defaultdict(list)
    for (lang, w), n in seen.items():
        if n >= least:
            kept[lang].append(w)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {a for a, _ in groups}:
        terms, sources = kept[lang], [b for a, b in groups if a == lang]
        got = {s: {w: count[lang, s, w] for w in terms} for s in sources}
        whole = {w: sum(got[s][w] for s in sources) for w in terms}
        share = lambda by: {w: 1 + 10**9 * (n + 2) // (sum(by.values()) + 2 * len(terms)) for w, n in by.items()}
        p, q = {s: share(got[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in terms)) for t in sources if t != s]
            best = [(w, f(p[s][w], q[w])) for w in terms if got[s][w] and p[s][w] > q[w]]
            for part, found, end in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:end]
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(ranked)]
    return sorted(out)


def run(spark, rows, least=2, top=3):
    df = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "lang string, source string, text string, term int, item string, value long")
    return sorted(tuple(r) for r in D.divergence(df, least, top).collect())


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE_BYTES", 64)
    words = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "K", "x1y", "don't", "日本", "a\x00b", "omega"]
    rows = []
    for i in range(240):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 9))
        rows.append((("en", "fr", None)[i % 3], f"s{i * i % 5}" if i % 11 else None, text))
    rows += [("en", "hot", "alpha Beta beta " * 50)] * 120 + [("de", "only", "eins zwei")] * 3 + [("fr", "silent", None), ("fr", "digits", "1 2 3"), ("xx", "a", "rare"), ("xx", "b", ""), ("en", "", "alpha")]
    assert run(spark, rows) == brute(rows, 2, 3)
    assert run(spark, rows, 10, 10) == brute(rows, 10, 10)


def test_ties_long_text_and_empty(spark):
    rows = [("l", s, "tie eit " + "wort " * 300_000 if s == "long" else "tie eit") for s in ("long", "b", "a", "B", "é")] * 2
    assert run(spark, rows) == brute(rows, 2, 3)
    assert run(spark, rows[:0]) == []


def test_shards_add_up_in_parts(spark, monkeypatch):
    """What a task hands on in several parts, and a shard adds up as it comes, gives the same rows."""
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD_ROWS", 8)
    texts = [f"{'abcdefg'[i % 7]} {'abc'[i % 3]} all" for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 60, "source": [f"s{i % 2}" for i in range(60)], "text": texts})
    counted = list(D._local_counts(iter([batch.slice(k, 5) for k in range(0, 60, 5)])))
    assert sum(b.num_rows for b in counted) > 15
    kept = pa.Table.from_batches(list(D._shard_counts(1)(iter(counted)))).to_pylist()
    want = Counter((f"s{i % 2}", w) for i in range(60) for w in texts[i].split())
    assert {(r["source"], r["term"]): r["n"] for r in kept} == dict(want) and len(kept) == len(want)
