import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from histria.llm import linededup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def cps(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(1, 3))
def test_within_is_edit_distance(a, b, tau):
    assert L.within(cps(a), cps(b), tau) == (distance(a, b) <= tau)


def mutated(r, s, edits):
    s = list(s)
    for _ in range(edits):
        i = r.randrange(len(s))
        r.choice([lambda: s.insert(i, r.choice("abé")), lambda: s.pop(i), lambda: s.__setitem__(i, r.choice("abé"))])()
    return "".join(s)


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root = [root[j] if x == root[i] else x for x in root]
    return root


def test_link_lines_finds_every_component():
    r = random.Random(5)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(24, 40))) for _ in range(25)]
    lines = list(dict.fromkeys(base + [mutated(r, r.choice(base), r.randrange(1, 4)) for _ in range(120)]))
    key = np.arange(len(lines))
    root = np.arange(len(lines))
    for a, b in L.link_lines(key, [cps(x) for x in lines], 2):
        assert distance(lines[a], lines[b]) <= 2
        root[root == root[a]] = root[b]
    want = components(len(lines), lambda i, j: distance(lines[i], lines[j]) <= 2)
    assert len({*zip(root.tolist(), want)}) == len(set(root.tolist())) == len(set(want))


def brute(rows, tau=2, least=24, short=False):
    """rows: (doc_id, text); the kept text of each. short: of equal lines under `least`, blank ones aside, the first stays."""
    lines, little = {}, {}
    for d, t in sorted(((d, t) for d, t in rows if t is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        for n, x in enumerate(t.split("\n")):
            if len(x) >= least:
                lines.setdefault(x, (d, n))
            elif x.strip():
                little.setdefault(x, (d, n))
    names = list(lines)
    root = components(len(names), lambda i, j: abs(len(names[i]) - len(names[j])) <= tau and distance(names[i], names[j]) <= tau)
    best = {}
    for x, c in zip(names, root):
        at = (lines[x][0] is not None, lines[x][0] or 0, lines[x][1])
        best[c] = min(best.get(c, at), at)
    of = dict(zip(names, root))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        stays = lambda x, n: not short or not x.strip() or little[x] == (d, n)  # noqa: B023, E731
        keep = [x for n, x in enumerate(t.split("\n")) if (stays(x, n) if len(x) < least else best[of[x]] == (d is not None, d or 0, n))]
        out.append((d, "\n".join(keep)))
    return out


def test_dedup_lines_against_brute_force(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abé ") for _ in range(r.randrange(24, 50))) for _ in range(12)]
    rows = [(None, base[0] + "\nshort")]
    for d in range(60):
        pick = [r.choice(base) if r.random() < 0.5 else mutated(r, r.choice(base), r.randrange(1, 5)) for _ in range(r.randrange(0, 6))]
        rows.append((d, "\n".join(pick + ["short", ""][: r.randrange(3)])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 600 + "\n" + "x" * 599)]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, gone string")
    for tile, long_list in ((1200, 32), (5, 3)):
        got = L.dedup_lines(df, tile=tile, long_list=long_list)
        assert got.columns == ["row", "n_lines", "n_removed", "kept"] and got.select("row.*").columns == df.columns
        got = got.select("row.doc_id", "kept").collect()
        key = lambda x: (x[0] is not None, x[0] or 0)
        assert sorted(((x["doc_id"], x["kept"]) for x in got), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_copies_of_short_lines_go_from_query_and_stage(spark, tmp_path):
    a, b = "a line of more than twenty-four characters", "another one of quite as many characters as that"
    texts = [f"Menu\n{a}\n\n \t\nMenu", f"Menu\n\n{b}\nMenü\nx", "Menu\r\nRead more\nx", "Menu\n\u3000\nx", None, "", "\n", "y" * 24 + "\n" + "z" * 23, "z" * 23 + "\n" + "y" * 23]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [f"Menu\n{a}\n\n \t", f"\n{b}\nMenü\nx", "Menu\r\nRead more", "\u3000", None, "", "\n", texts[7], "y" * 23]
    kept = {r["row"]["doc_id"]: r["kept"] for r in L.dedup_lines(docs, short=True).collect()}
    assert kept == dict(enumerate(want))
    got = {r["doc_id"]: (r["n_removed"], r["kept_chars"]) for r in L.query(spark, str(tmp_path)).collect()}
    assert got == {i: (0 if t is None else t.count("\n") - w.count("\n"), len(w or "")) for i, (t, w) in enumerate(zip(texts, want))}
    # Document 3 has nothing but white space left.
    assert {r["doc_id"]: r["text"] for r in L.stage(spark, docs, "").collect()} == {i: w for i, w in enumerate(want) if i != 3}


def test_a_document_of_very_many_repeated_lines(spark):
    line = "a line of more than twenty-four characters"
    texts = ["\n".join([line, "Menu"] * 150_000 + ["the end of this very long document, said once"]), f"{line}\nMenu\nown"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in L.dedup_lines(df, short=True).select("row.doc_id", "n_lines", "n_removed", "kept").collect()}
    assert got == {0: (300_001, 299_998, f"{line}\nMenu\nthe end of this very long document, said once"), 1: (3, 2, "own")}


def test_tables_go_once_they_are_used(spark):
    """entries are not written as a table, and of the other tables only what the lazy result reads is left."""
    from pathlib import Path

    from histria.llm.common import scratch

    folder = Path(scratch(spark).removeprefix("file://"))
    before = {p.name for p in folder.glob("*")}
    line = "a line of more than twenty-four characters"
    df = spark.createDataFrame([(0, f"{line}\nMenu"), (1, f"{line}s\nMenu")], "doc_id long, text string")
    got = L.dedup_lines(df, short=True)
    new = {p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before}
    assert not new & {"lines", "classes", "named", "several"} and "gone" in new
    assert {r["row"]["doc_id"]: r["kept"] for r in got.collect()} == {0: f"{line}\nMenu", 1: ""}
