import re

import pytest

from histria.llm import licenses as L


def words_of(text):
    lower = str.maketrans(L.UPPER, L.UPPER.lower())
    return re.findall(L.WORD, (text or "").translate(lower))


def brute(texts, phrases, templates, lookups):
    """[(n_words, {label: (starts, score)} of phrases, of templates)] by trying every start."""
    docs = [words_of(t) for t in texts]
    vocabulary = {w for t in (*phrases, *templates) for w in t.text.split()}
    df = {w: sum(w in d for d in map(set, docs)) for w in vocabulary}
    x = {w: ((len(docs) + 1) // (df[w] + 1)).bit_length() for w in vocabulary}
    out = []
    for d in docs:
        got = []
        for group in (phrases, templates):
            found = {}
            for t in group:
                want, must = t.text.split(), L.key_places(t)
                order = sorted((i for i in range(len(want)) if want[i] in d), key=lambda i: (df[want[i]], want[i], i))
                asked = must | set(order[:lookups])
                at = lambda s, i: 0 <= s + i < len(d) and d[s + i] == want[i]  # noqa: B023, E731
                starts = [s for s in range(-len(want), len(d)) if all(at(s, i) for i in asked)]
                if starts:
                    share = sum(x[want[i]] for s in starts for i in range(len(want)) if at(s, i)) / (sum(x[w] for w in want) * len(starts))
                    found[t.label] = (starts, share)
            got.append(found)
        out.append((len(d), *got))
    return out


TEXTS = [
    None, "", "...", "CC-BY", "cc by CC BY cc, by cc by", "by cc", "All rights reserved. all RIGHTS\nreserved", "all rights are reserved", "generalpublic license GENERAL Public licensE",
    "This work is licensed under the GNU General Public License, version 3.", "this work was licensed under a GNU General Public License version 3", "GNU general public license version 2 all",
    "Licensed under CC BY-NC 4.0. x CC BY-SA 4.0", "Released under the MIT License.", "the MIT license is meant", "MIT released under the licence", "x " * 50 + "Licensed under the Apache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any one obtaining a copy of that software", "permission is hereby granted to all obtaining a copy", "CCK by ccé by cc by", "İ all rights reserved",
    "the of to " * 400 + "subject to the terms of the Mozilla Public License, v. 2.0", "license " * 3000 + "general public license", "wort " * 300_000 + "all rights reserved " * 20_000,
]


@pytest.mark.parametrize("lookups", [0, 1, 3, 6])
def test_brute_force(spark, lookups):
    texts = TEXTS[:-1] if lookups else TEXTS[:12]
    df = spark.createDataFrame([(i, t, ["a"], 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, words array<string>, occ int, present string")
    got = {r["doc_id"]: r for r in L.scan_licenses(df, lookups=lookups).collect()}
    assert len(got) == len(texts)
    for i, (n, base, more) in enumerate(brute(texts, L.PHRASES, L.TEMPLATES, lookups)):
        assert got[i]["n_words"] == n
        for have, want in ((got[i]["base"], base), (got[i]["more"], more)):
            assert {h["label"]: (sorted(h["starts"]), round(h["score"], 9)) for h in have} == {k: (s, round(v, 9)) for k, (s, v) in want.items()}, texts[i]


def test_long_text_null_ids_and_repeated_rows(spark):
    rows = [(None, TEXTS[-1]), (3, "cc by"), (3, "cc by"), (None, None)]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=()).collect()
    places = sorted((r["doc_id"] or -1, r["n_words"], sum(len(b["starts"]) for b in r["base"]), len(r["more"])) for r in got)
    assert places == [(-1, 0, 0, 0), (-1, 360_000, 20_000, 0), (3, 2, 1, 0), (3, 2, 1, 0)]


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_key_phrase_must_be_in_the_text():
    with pytest.raises(ValueError):
        L.key_places(L.Template("x", "a b c", ("a c",)))
