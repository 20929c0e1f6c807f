r"""License scan by a positional index of rare words (operator 12, DataFrame functions only).

A template is a license's wording with key phrases that must stand in it. For each file and template the file's rarest
(highest-IDF) words of the template are looked up: their places, less the word's place in the template, are the starts at
which the template would lie. The starts on which these words and all words of the key phrases agree are the places found.
A plain phrase is a template that is nothing but key phrase, so it is found wherever its words stand in a row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs before A-Z is lowered.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rarest words of a template that are looked up in a file, besides the key phrases' words.
LOOKUPS = 3


class Template(NamedTuple):
    label: str
    text: str  # lower-case words
    keys: tuple[str, ...]  # phrases of the text that must stand in it


# The phrases of the base scan.
PHRASES = (
    Template("cc-by", "cc by", ("cc by",)),
    Template("gpl", "general public license", ("general public license",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
)
# What well-known licenses say of themselves.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "obtaining a copy")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def key_places(t: Template) -> set[int]:
    """Places of the template's words that belong to key phrases."""
    words, found = t.text.split(), set()
    for phrase in t.keys:
        k = phrase.split()
        at = next((i for i in range(len(words)) if words[i : i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"{t.label}: no key phrase {phrase!r}")
        found |= set(range(at, at + len(k)))
    return found


def find_words(docs: DataFrame, id_col: str, text_col: str, known: list[str]) -> DataFrame:
    """doc_id, n_words, occ (array of word and place, known words only): one row a row of docs, from its whole text."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RAW_WORD), F.lit(0))
    d = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    near = F.filter(placed, lambda o: F.lower(o["w"]).isin(known))  # lower() takes in more than A-Z
    exact = F.filter(F.transform(near, lambda o: F.struct(F.translate(o["w"], UPPER, UPPER.lower()).alias("w"), o["p"].alias("p"))), lambda o: o["w"].isin(known))
    return d.select("doc_id", F.size("words").cast("long").alias("n_words"), exact.alias("occ"))


def document_frequencies(found: DataFrame, known: list[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and of those with each known word. As many numbers as there are known words come to the driver."""
    each = found.select(F.explode(F.array_distinct(F.transform("occ", lambda o: o["w"]))).alias("w")).groupBy("w").count()
    return found.count(), {w: 0 for w in known} | {r["w"]: r["count"] for r in each.collect()}


def weight(total: int, holding: int) -> int:
    """IDF in whole bits: binary digits of (rows + 1) div (rows with the word + 1)."""
    return ((total + 1) // (holding + 1)).bit_length()


def _literal(templates: tuple[Template, ...], total: int, df: dict[str, int]) -> Column:
    """The index: every template's words, rarest first (ties: word, then place), each with its place, weight and whether a key phrase holds it."""
    out = []
    for t in templates:
        must, words = key_places(t), t.text.split()
        order = sorted(range(len(words)), key=lambda i: (df[words[i]], words[i], i))
        entry = lambda i: F.struct(F.lit(words[i]).alias("w"), F.lit(i).alias("k"), F.lit(weight(total, df[words[i]])).alias("x"), F.lit(i in must).alias("must"))  # noqa: B023, E731
        out.append(F.struct(
            F.lit(t.label).alias("label"), F.array(*map(entry, order)).alias("words"), F.array(*(F.lit(w) for w in sorted({words[i] for i in must}))).alias("needed"),
            F.lit(sum(weight(total, df[w]) for w in words)).alias("total"),
        ))
    return F.array(*out)


def _starts(occ: Column, entry: Column) -> Column:
    """Where the template would begin by each place of one of its words."""
    return F.transform(F.filter(occ, lambda o: o["w"] == entry["w"]), lambda o: o["p"] - entry["k"])


def _found(templates: Column, lookups: int) -> Column:
    """For each template of which all key words are in the file: label, starts, covered and total weight over these starts."""
    occ, present = F.col("occ"), F.col("present")
    open_ = F.filter(templates, lambda t: F.size(F.array_except(t["needed"], present)) == 0)

    def scan(t: Column) -> Column:
        here = F.filter(t["words"], lambda e: F.array_contains(present, e["w"]))
        asked = F.filter(here, lambda e, i: e["must"] | (i < lookups))
        starts = F.reduce(F.slice(asked, 2, F.size(asked)), F.array_distinct(_starts(occ, F.get(asked, F.lit(0)))), lambda got, e: F.array_intersect(got, _starts(occ, e)))
        return F.struct(t["label"].alias("label"), starts.alias("starts"), here.alias("here"), t["total"].alias("total"))

    def cover(t: Column) -> Column:
        each = F.transform(t["here"], lambda e: F.size(F.array_intersect(t["starts"], _starts(occ, e))).cast("long") * e["x"])
        return F.struct(t["label"].alias("label"), t["starts"].alias("starts"), F.reduce(each, F.lit(0).cast("long"), lambda a, b: a + b).alias("covered"), t["total"].alias("total"))

    return F.transform(F.filter(F.transform(open_, scan), lambda t: F.size(t["starts"]) > 0), cover)


def scan_licenses(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, lookups: int = LOOKUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base and more: arrays of (label, starts, score), one entry for each phrase or template found.

    A start is the number of the word at which it begins. A template is found where its key phrases stand whole and the
    `lookups` words of it that are in the file and rarest in the corpus agree on the place; other words may differ.
    score = weight of the template's words that stand in their places, against the weight of all, over its places. Weights
    are IDF over all documents. A phrase has score 1.

    Every row of docs gives one row, repeated rows and null ids too; a null or empty text has no words. Words are told by
    the ASCII ranges of WORD and only A-Z is lowered. The vocabulary is the templates' words, so the index and the
    frequencies on the driver are bounded by the parameters. A row is worked on where it is; nothing is shuffled but one
    count a word. The places of known words are written once (not the texts) and read for both passes. Other columns of docs are not read.
    """
    known = sorted({w for t in (*phrases, *templates) for w in t.text.split()})
    found = materialize(find_words(docs, id_col, text_col, known), "license-words")
    total, df = document_frequencies(found, known)
    with_words = found.withColumn("present", F.array_distinct(F.transform("occ", lambda o: o["w"])))
    shown = lambda c: F.transform(c, lambda t: F.struct(t["label"].alias("label"), t["starts"].alias("starts"), (t["covered"] / (t["total"] * F.size(t["starts"]))).alias("score")))
    of = lambda ts: shown(_found(_literal(ts, total, df), lookups)) if ts else F.array().cast("array<struct<label:string,starts:array<int>,score:double>>")
    return with_words.select("doc_id", "n_words", of(phrases).alias("base"), of(templates).alias("more"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan_licenses(table(spark, sf_dir, "documents"))
    places = F.flatten(F.transform("base", lambda t: t["starts"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda t: t["label"]))), ",")
    both = F.concat("base", "more")
    return hits.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(both).alias("labels"), F.coalesce(F.array_max(F.transform(both, lambda t: t["score"])), F.lit(0.0)).alias("score"),
    )


def _values(templates: tuple[Template, ...], base: bool) -> str:
    rows = []
    for t in templates:
        must = key_places(t)
        rows += [f"('{t.label}', {str(base).lower()}, {k}, '{w}', {str(k in must).lower()})" for k, w in enumerate(t.text.split())]
    return ", ".join(rows)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM documents),
t(label, base, k, w, must) AS (VALUES {_values(PHRASES, True)}, {_values(TEMPLATES, False)}),
o AS (SELECT r, w, p FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM d) SEMI JOIN t USING (w)),
n AS (SELECT w, count(DISTINCT r) AS df, 0 AS z FROM o GROUP BY w),
b AS (SELECT DISTINCT t.w, coalesce(df, 0) AS df, len(ltrim(bin(((SELECT count(*) FROM d) + 1) // (coalesce(df, 0) + 1)), '0')) AS x FROM t LEFT JOIN n ON t.w = n.w),
i AS (SELECT t.*, df, x, sum(x) OVER (PARTITION BY label, base) AS total, count(*) FILTER (must) OVER (PARTITION BY label, base) AS n_must FROM t JOIN b USING (w)),
e AS (SELECT q.r, i.label, i.base, i.k, row_number() OVER (PARTITION BY q.r, i.label, i.base ORDER BY i.df, i.w, i.k) <= {LOOKUPS} AS top FROM (SELECT DISTINCT r, w FROM o) q JOIN i USING (w)),
h AS (SELECT o.r, i.label, i.base, o.p - i.k AS start, i.must, i.x, i.total, i.n_must, e.top FROM o JOIN i USING (w) JOIN e ON e.r = o.r AND e.label = i.label AND e.base = i.base AND e.k = i.k),
tops AS (SELECT r, label, base, count(*) AS n_top FROM e WHERE top GROUP BY ALL),
s AS (SELECT r, label, base, start, sum(x) AS covered, any_value(total) AS total FROM h JOIN tops USING (r, label, base) GROUP BY ALL
  HAVING count(*) FILTER (must) = any_value(n_must) AND count(*) FILTER (top) = any_value(n_top)),
g AS (SELECT r, label, base, sum(covered) / (any_value(total) * count(*)) AS score, count(*) AS places, min(start) AS a, max(start) AS z FROM s GROUP BY r, label, base),
m AS (SELECT r, sum(places) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(z) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM g GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN m USING (r)
"""
