"""The pipeline against brute force, stage by stage: each stage's input is what the stage before it wrote."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline as C
from histria.llm import langid

from .test_decontam import brute as contaminated
from .test_jaccard import brute as groups
from .test_linededup import brute as deduplicated


def corpus(r):
    words = {"de": "der und die das ist nicht ein zu mit auf für".split(), "en": "the and of to in is that it was for on".split()}
    line = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice("abcdefgh") * (r.random() < 0.5) for _ in range(n))
    bench = [(i, line("en", 30)) for i in range(4)]
    docs = []
    for i in range(60):
        lang = r.choice(["de", "en"])
        body = [line(lang, r.randrange(8, 30)) for _ in range(r.randrange(1, 5))]
        if i % 6 == 0 and docs:
            body = r.choice(docs)[1].split("\n") + ["one more line of words"]
        if i % 9 == 0:
            body.append(r.choice(bench)[1])
        docs.append((i, "\n".join(body), lang))
    return docs + [(100, None, None), (101, "", "en"), (102, "12 34 !!", "en"), (103, docs[0][1], "de"), (104, "kurz", "de")], bench


def test_stages(spark, tmp_path):
    docs, bench = corpus(random.Random(3))
    rows = [(d, t, lang, "src", None if t is None else len(t)) for d, t, lang in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "pack"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    kept = {}
    for name, f in C.STAGES:
        before = [(x["doc_id"], x["text"]) for x in now.collect()]
        out = f(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = kept[name] = out.collect()
        if name != "pack":
            assert out.columns == names
        got = Counter((x["doc_id"], x["text"]) for x in after) if name != "pack" else None
        if name == "language_id":
            model = langid.trained_on(now)
            keep = {x["doc_id"] for x in langid.identify(now, model).collect() if x["lang_pred"] != "und" and x["certainty"] >= langid.MIN_CERTAINTY}
            assert got == Counter(x for x in before if x[0] in keep) and not keep & {100, 101, 102}
        elif name == "line_dedup":
            old = dict(before)
            assert got == Counter((d, t) for d, t in deduplicated(before, short=True) if t == old[d] or t.strip())
            assert all(x["n_chars"] == len(x["text"]) for x in after)
        elif name == "ngram_jaccard":
            assert got == Counter((d, t) for (d, t) in before if any(g[0] == d == g[2] for g in groups(before)))
        elif name == "decontaminate":
            bad = {d for d, n, hit, _ in contaminated(before, bench) if hit and 20 * hit >= n}
            assert bad and got == Counter(x for x in before if x[0] not in bad)
        else:
            assert {x["doc_id"] for x in after} == {d for d, _ in before}
            per = {}
            for x in after:
                per.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
            for spans in per.values():
                spans.sort()
                assert [o for o, _ in spans] == np.r_[0, np.cumsum([n for _, n in spans])[:-1]].tolist() and sum(n for _, n in spans) <= 4096
        now = out
    key = lambda x: (x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"])
    assert sorted(map(key, C.run(spark, str(tmp_path)).collect())) == sorted(map(key, kept["pack"]))


def test_edges_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, rows that occur twice, one id on several texts, clashing extra columns, an empty table."""
    docs, bench = corpus(random.Random(5))
    rows = [(d, t, lang, i) for i, (d, t, lang) in enumerate(docs)]
    english = "the and of to in is that it was for on the other of and to the"
    rows += [(None, english, "en", 1), (None, english, "en", 1), (7, english + " so", "en", 2), (7, "das ist nicht ein und die der auf für", "de", 3), (7, None, None, 4), (None, None, None, 4), (None, "", "en", 5)]
    df = spark.createDataFrame([(d, t, lang, k, k, f"x{k}") for d, t, lang, k in rows], "doc_id long, text string, lang string, n long, component long, digest string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in C.STAGES:
        out = f(spark, now, str(tmp_path))
        assert name == "pack" or out.columns == df.columns
        if name != "pack":
            out.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
    texts = Counter(x["text"] for x in now.collect())
    assert sum(english in (t or "") for t in texts) == 1 and not {None, ""} & set(texts)
    assert {x["doc_id"] for x in now.where("text like 'das ist nicht%'").collect()} == {7}
    for name, f in C.STAGES:
        assert f(spark, df.where("false"), str(tmp_path)).count() == 0, name


def test_language_stage_keeps_mixed_texts(spark):
    """A text of three languages in even shares has none that holds half of it, and stays; one without letters goes."""
    r = random.Random(8)
    words = {"de": "der und die das ist nicht ein zu mit auf".split(), "en": "the and of to in is that it was for".split(), "fr": "le et les des est pas une pour dans avec".split()}
    line = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(i, line(lang, 20), lang) for i, lang in enumerate(["de", "en", "fr"] * 30)]
    rows += [(1000, " ".join(line(lang, 30) for lang in words), None), (1001, "12 34", None), (1002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = langid.identify(docs, langid.trained_on(docs)).where("doc_id = 1000").first()
    assert mixed["score"] < 0.5 < mixed["certainty"]
    kept = {x["doc_id"] for x in langid.stage(spark, docs, "").collect()}
    assert kept == {*range(90), 1000}
    assert not langid.stage(spark, docs, "", min_certainty=1.1).count()


def test_a_stage_leaves_only_its_own_table(spark, tmp_path):
    """the table a stage read is deleted once the next one is written."""
    from pathlib import Path

    from histria.llm.common import scratch

    docs, bench = corpus(random.Random(6))
    spark.createDataFrame([(d, t, lang) for d, t, lang in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = Path(scratch(spark).removeprefix("file://"))
    before = set(folder.glob("pipeline-*"))
    out = C.run(spark, str(tmp_path))
    (mine,) = set(folder.glob("pipeline-*")) - before
    assert [p.name for p in mine.iterdir()] == ["4-pack"] and out.count()
