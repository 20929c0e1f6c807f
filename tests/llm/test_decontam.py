import random
import re

from histria.llm import decontam as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m and i is not None else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                got = windows.get(tuple(w[k : k + m]))
                if got:
                    hit.update(range(k, k + m))
                    items |= got
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "b_c", "x-y"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, say(r.randrange(1, 40))) for i in range(25)] + [(100, "w1 w2 w3"), (101, "  "), (102, None), (None, say(20)), (3, say(15)), (103, "Only ONE-of these words, ever")]
    docs = []
    for i in range(120):
        w = say(r.randrange(0, 60)).split()
        if r.random() < 0.6:
            b = (r.choice(bench)[1] or "").split()
            a = r.randrange(0, max(1, len(b) - 12))
            w[r.randrange(len(w) + 1) : 0] = b[a : a + r.randrange(1, 30)]
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "!!!"), (503, docs[0][1]), (None, docs[1][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, items int")
    bf = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")
    for size in (D.BLOCK_BYTES, 900):
        got = D.verdict(D.contamination(df, bf, block_bytes=size)).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute(docs, bench)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contamination(d, b.where("false")).first()["items"] == []
    assert D.contamination(d.where("false"), b).count() == 0
    assert D.contamination(d, b).first()["spans"][0].asDict() == {"start": 0, "end": 3}


def test_blocks_decide_row_by_row_like_one(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, say(30)) for i in range(12)]
    # Null and repeated ids, all of 30 words: clean ones, ones that one or two items hit, and whole copies of rows.
    mixed = " ".join(bench[1][1].split()[:15] + bench[7][1].split()[:15])
    texts = [say(30), bench[2][1], mixed, say(30), mixed, bench[2][1], "", None]
    docs = [(d, t) for d in (None, 5) for t in texts] + [(6, say(30)), (7, mixed)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, digest int")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    assert D._blocks(bf, 300)[1] > 5
    shown = lambda size: sorted((str(tuple(x)) for x in D.contamination(df, bf, block_bytes=size).collect()))
    assert shown(300) == shown(D.BLOCK_BYTES) and len(shown(300)) == len(docs)
    got = D.verdict(D.contamination(df, bf, block_bytes=300)).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in got), key=str) == brute(docs, bench)
    bad = {mixed, bench[2][1]}
    for size in (300, D.BLOCK_BYTES):
        kept = D.clean_documents(df, bf, block_bytes=size)
        assert kept.columns == df.columns
        assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted(((d, t) for d, t in docs if t not in bad), key=str)
