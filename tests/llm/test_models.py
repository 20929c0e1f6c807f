"""Language identification, quality and nearest neighbours: contracts, edges and held-out accuracy."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from histria.llm import hnsw, langid, quality
from histria.llm import kernels as K

from ..compare import has_data

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_language_of_held_out_documents(spark):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.query(spark, SF).collect()
    assert len(got) == len(want) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    model = langid.fit([("der und die das ist nicht " * 20, "de"), ("the and of to in is " * 20, "en")] * 3)
    rows = [(1, None), (2, ""), (3, "12 34 …"), (4, "the of and the"), (5, "und der nicht"), (None, "the and"), (4, "the of and the"), (6, "und " * 30_000)]
    df = spark.createDataFrame([(d, t, "xx", 0.1) for d, t in rows], "doc_id long, text string, lang string, score double")
    got = {(r["doc_id"], r["n_words"]): r for r in langid.identify(df, model).collect()}
    assert [got[1, 0]["lang_pred"], got[2, 0]["lang_pred"], got[4, 4]["lang_pred"], got[5, 3]["lang_pred"], got[6, 30_000]["lang_pred"]] == ["und", "und", "en", "de", "de"]
    assert next(r for (d, _), r in got.items() if d == 3)["lang_pred"] == "und"
    none = langid.identify(df, langid.fit([])).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}
    assert langid.identify(df.where("false"), model).count() == 0
    assert langid.trained_on(df.where("false")).labels == []


def test_code_switched_words_change_label():
    model = langid.fit([("der und die das ist nicht " * 20, "de"), ("the and of to in is " * 20, "en")] * 3)
    b = pa.record_batch([pa.array([1]), pa.array([False]), pa.array(["the of and to in is der und die das ist nicht"])], ["doc_id", "held_out", "text"])
    (s,) = K.text_slices(iter([b]), "text")
    shares = langid.predict(model, s).column("shares")[0].as_py()
    assert shares == pytest.approx([0.5, 0.5], abs=0.1)


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    m = langid.Model(["a", "b", "c"])
    m.transitions = r.normal(size=(3, 3))
    scores = r.normal(size=(9, 3))
    start, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, _ = m.posteriors(scores.copy(), start, length)
    import itertools

    for a, n in zip(start, length):
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(m.transitions[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += w
        assert got[a : a + n] == pytest.approx(p / p.sum(1, keepdims=True))


def test_long_texts_are_labelled_as_by_one_chain():
    r = np.random.default_rng(3)
    model = langid.fit([("der und die das ist nicht ein auf " * 20, "de"), ("the and of to in is that on " * 20, "en")] * 3)
    words = "der und die das ist nicht ein auf the and of to in is that on xyz qq".split()
    text = " ".join(words[i] for i in r.integers(0, len(words), 1500))
    (s,) = K.text_slices(iter([pa.record_batch([pa.array([1]), pa.array([False]), pa.array([text])], ["doc_id", "held_out", "text"])]), "text")
    w = K.words(s.data, s.off, langid.LETTERS)
    score, back = model.emissions(s.data, w)
    whole, _ = model.posteriors(score[back], np.array([0]), np.array([1500]))
    assert langid.predict(model, s).column("shares")[0].as_py() == pytest.approx(whole.mean(0).tolist(), abs=1e-6)


def test_features_of_words():
    """Affixes of one to three bytes, bigrams, trigrams and the word, from their definition."""
    (s,) = K.text_slices(iter([pa.record_batch([pa.array(["Haus am Käse x"])], ["t"])]), "t")
    w = K.words(s.data, s.off, langid.LETTERS)
    f, off = langid.features(s.data, w)
    bucket = lambda tag, value: int(K.mix(np.array([value], np.uint64) * np.uint64(16) + np.uint64(tag))[0] % np.uint64(langid.BUCKETS))
    number = lambda b: int.from_bytes(bytes(b), "big")
    for i, word in enumerate(["haus", "am", "käse", "x"]):
        b = word.encode()
        want = [bucket(0, int(w.h[i]))]
        for k in (1, 2, 3):
            pad = b + b"\0\0"
            want += [bucket(k, number(pad[:k])), bucket(3 + k, number(b[::-1].ljust(3, b"\0")[:k]))]
        want += [bucket(7, number(b[j : j + 2])) for j in range(len(b) - 1)] + [bucket(8, number(b[j : j + 3])) for j in range(len(b) - 2)]
        assert sorted(f[off[i] : off[i + 1]].tolist()) == sorted(want), word


def test_quality_scores_one_text_at_a_time():
    """The batched forward pass against the formula, passage by passage in plain loops."""
    r = np.random.default_rng(2)
    texts = ["", "One short text, of few words.", " ".join(f"w{i % 37}" for i in range(300)), "x!! 12 ÉÉ\n" * 50]
    (s,) = K.text_slices(iter([pa.record_batch([pa.array(texts)], ["t"])]), "t")
    x, off = quality.passages(s.data, s.off)
    m = quality.Model(x.mean(0), x.std(0) + 0.1, 0.2)
    m.p["c"] = r.normal(size=quality.HIDDEN)
    sigmoid = lambda a: 1 / (1 + math.exp(-a))
    p = m.p
    for k in range(len(texts)):
        hs, scores = [], []
        for row in x[off[k] : off[k + 1]]:
            a = [(float(v) - float(u)) / float(w) for v, u, w in zip(row, m.mean, m.std)]
            h = [math.tanh(sum(a[i] * p["W"][i, j] for i in range(len(a))) + p["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * sigmoid(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(quality.GATE)]
            hs.append(h)
            scores.append(sum(g * w for g, w in zip(gate, p["w"])))
        weight = [math.exp(v - max(scores)) for v in scores]
        z = [sum(w * h[j] for w, h in zip(weight, hs)) / sum(weight) for j in range(quality.HIDDEN)]
        assert m.score(x, off)[k] == pytest.approx(sigmoid(sum(a * b for a, b in zip(z, p["c"])) + p["d"]), abs=1e-6)


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_quality_of_held_out_documents(spark):
    want = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.query(spark, SF).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.95


def test_quality_gradient_and_edges(spark):
    r = np.random.default_rng(0)
    x, off, y = r.normal(size=(12, quality.N_FEATURES)), np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])
    m = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), 0.1)
    m.p["c"] = r.normal(size=quality.HIDDEN)
    loss = lambda: -np.mean(y * np.log(m.forward(x, off)["score"]) + (1 - y) * np.log(1 - m.forward(x, off)["score"]))
    for k, g in m.gradient(x, off, y).items():
        flat = m.p[k].reshape(-1)
        for i in (0, flat.size // 2):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert np.ravel(g)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), k
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 50_000), (3, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, 3, 0.5) for d, t in rows], "doc_id long, text string, predicted int, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(df, quality.train(df, labels)).collect()
    assert len(got) == 5 and {x["score"] for x in got} == {0.5}
    assert quality.score_quality(df.where("false"), m).count() == 0


def neighbours(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            s = sorted(((-float(np.dot(np.array(v, np.float64), np.array(w, np.float64))), i) for i, w in rows if i != q))
            out[q] = [i for _, i in s[:k]]
    return out


def test_recall_with_copies_and_bad_vectors(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 16)).astype(np.float32) * r.uniform(0.5, 2, (900, 1)).astype(np.float32)
    v[100:400] = v[0]
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows + bad + rows[:3]], "vec_id long, embedding array<float>, rank int")
    got = hnsw.search(df, df.where("vec_id % 20 = 0"), shard_rows=250, query_rows=20).collect()
    want = neighbours(rows, 20)
    by = {}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        by.setdefault(x["query_id"], []).append(x)
    assert by.keys() == want.keys() and all([x["rank"] for x in b] == list(range(1, 21)) for b in by.values())
    assert np.mean([len({x["vec_id"] for x in by[q]} & set(want[q])) / 20 for q in want]) > 0.97
    w = dict(rows)
    for x in got[:200]:
        assert x["score"] == pytest.approx(np.dot(np.array(w[x["query_id"]]), np.array(w[x["vec_id"]])), abs=1e-9)
    assert [x["vec_id"] for x in by[100]] == want[100]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = hnsw.search(df, df.where("vec_id % 20 = 0")).collect()
    assert [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"])] == [4, 3, 2, 1]
    assert hnsw.search(df.where("false"), df.where("false")).count() == 0


def test_query_rows_of_one_id_are_one_query(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 4.0])], "vec_id long, embedding array<float>")
    got = hnsw.search(df, df.where("vec_id = 20"), 2).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 5.0), (2, 2, 4.0)]
