"""Benchmark decontamination by winnowing (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, small, table

WINDOW = 13
GRAM = 5
#: Benchmark text indexed and broadcast at once; a larger benchmark is worked through in blocks of this size.
BLOCK_BYTES = 8 << 20
_OUT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


class Index:
    """Windows of a block of benchmark items: by word count sorted hashes, each with its items, and the fingerprints."""

    def __init__(self, rows: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        data = pa.array([t or "" for _, t in rows], pa.large_string())
        self.items = np.array([i for i, _ in rows], object)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = [np.zeros(0, K.U64)]
        for k, s in enumerate(K.text_slices(iter([pa.record_batch([data.slice(i, 1)], ["t"]) for i in range(len(rows))]), "t")):
            h = K.words(s.data, s.off, K.ALNUM).h
            m = min(window, len(h))
            if m:
                g = np.unique(K.grams(h, m))
                found.setdefault(m, []).append((g, np.full(len(g), k)))
                if m == window:
                    prints.append(K.sliding_min(K.mix(K.grams(h, gram)), window - gram + 1))
        self.prints = np.unique(np.concatenate(prints))
        self.by_length = {}
        for m, parts in found.items():
            h, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            self.by_length[m] = (h[first], np.r_[first, len(h)], item)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are among them, and at what index."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x, at


def mark(s: K.Slice, index: Index) -> pa.RecordBatch:
    w, ids = K.words(s.data, s.off, K.ALNUM), s.rows.column(0)
    n, docs = len(w.h), len(ids)
    doc = K.segments_of(w.off)
    last = w.off[1:][doc]  # end of each word's document
    cover = np.zeros(n + 1, np.int64)
    items: dict[int, set] = {}
    acc = w.h
    for m in range(1, index.window + 1):
        acc = acc if m == 1 else K.grow(acc, w.h, m)
        if m == index.gram:
            gram = K.mix(acc)
        if m not in index.by_length or not len(acc):
            continue
        hashes, off, of_item = index.by_length[m]
        inside = np.arange(len(acc)) + m <= last[: len(acc)]
        if m == index.window:
            low = K.sliding_min(gram, index.window - index.gram + 1)  # each window's fingerprint
            change = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            hit = np.repeat(_among(index.prints, low[change])[0], np.diff(np.r_[change, len(low)]))
            where = np.flatnonzero(hit & inside)
        else:
            where = np.flatnonzero(inside)
        ok, at = _among(hashes, acc[where])
        where, at = where[ok], at[ok]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + m, -1)
        for d, a in np.unique(np.stack([doc[where], at], 1), axis=0) if len(where) else ():
            items.setdefault(int(d), set()).update(index.items[of_item[off[a] : off[a + 1]]])
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.zeros(n, bool)
    edge[w.off[:-1][w.off[:-1] < n]] = True
    starts = np.flatnonzero(hit & (np.r_[True, ~hit[:-1]] | edge)) if n else np.zeros(0, int)
    ends = np.flatnonzero(hit & np.r_[~hit[1:] | edge[1:], True]) + 1 if n else starts
    of = np.searchsorted(starts, w.off)
    base = w.off[:-1][doc[starts]] if len(starts) else starts
    spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"]))
    names = pa.array([sorted(items.get(i, ())) for i in range(docs)], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.diff(w.off), pa.int64()), spans, names], schema=_SCHEMA)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item is not null")
    return bench, max(1, -(-int(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))


def _shared(bench: DataFrame, blocks: int, b: int, window: int, gram: int):
    rows = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]
    return bench.sparkSession.sparkContext.broadcast(Index(rows, window, gram))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, end exclusive), items (ids as strings, sorted): one row per row of docs.

    Each run of `window` words is represented by the smallest hash of its `gram`-word grams (winnowing), so any shared
    run of at least `window` words shares a fingerprint; runs of windows with a known fingerprint are then compared
    window by window (64-bit hashes of all words), and consecutive hits join to spans. An item of fewer words is one
    window of its own length. The index of a block of at most `block_bytes` benchmark text is broadcast; documents are
    scanned once a block, with no shuffle; of several blocks, the hits meet per text (a digest) and go back to each row.

    Null texts have no words; items without words, or with null id, hit nothing; repeated items and documents are
    harmless; an empty benchmark marks nothing; extra columns are ignored.
    """
    bench, blocks = _blocks(benchmark, block_bytes)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks == 1:
        return slim.mapInArrow(_marker(_shared(bench, 1, 0, window, gram)), _OUT)
    rows, hits = _block_hits(slim, bench, blocks, window, gram)
    both = rows.join(small(hits.drop("n_words"), 96, ("spans", "spans", "items", "items", "items", "items")), "digest", "left")
    return both.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def _marker(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            yield mark(s, shared.value)

    return run


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _block_hits(slim: DataFrame, bench: DataFrame, blocks: int, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, digest of each row; digest, n_words, spans, items of each text that a block hits). What hits a
    row depends on its text alone."""
    keyed = slim.select("doc_id", "text", _digest().alias("digest"))
    found = None
    for b in range(blocks):
        shared = _shared(bench, blocks, b, window, gram)

        def run(it: Iterator[pa.RecordBatch], shared=shared, b=b) -> Iterator[pa.RecordBatch]:
            for s in K.text_slices(it, "text"):
                got = pa.RecordBatch.from_arrays([*mark(s, shared.value).columns, s.rows.column(2)], [*_SCHEMA.names, "digest"])
                # Each row once, from the first block; of the others its hits only.
                yield got if b == 0 else got.filter(pc.greater(pc.list_value_length(got.column(2)), 0))

        one = keyed.mapInArrow(run, f"{_OUT}, digest string").withColumn("block", F.lit(b))
        found = one if found is None else found.unionByName(one)
    found = materialize(found, "found")
    # Copies of a text have equal hits in each block, so the sets hold one value a block at most.
    hits = found.where(F.size("spans") > 0).groupBy("digest", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = materialize(hits.withColumn("spans", _join_spans(F.col("spans"))), "hits")
    return found.where("block = 0").select("doc_id", "n_words", "digest"), hits


def _join_spans(spans):
    """Sorted, with overlapping or touching ranges joined."""
    step = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def verdict(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated rows, decided row by row, in one scan. With several blocks of benchmark text the verdicts
    of the texts that they hit are joined by digest instead."""
    bench, blocks = _blocks(benchmark, block_bytes)
    if blocks > 1:
        _, hits = _block_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bench, blocks, WINDOW, GRAM)
        bad = materialize(verdict(hits).where("contaminated").select("digest"), "contaminated")
        return docs.join(small(bad, 80), _digest() == bad["digest"], "left_anti")
    shared = _shared(bench, 1, 0, WINDOW, GRAM)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            probe = pa.RecordBatch.from_arrays([pa.array(np.zeros(s.rows.num_rows, np.int64))], ["doc_id"])
            found = mark(K.Slice(probe, s.data, s.off), shared.value)
            hit = [sum(x["end"] - x["start"] for x in spans) for spans in found.column("spans").to_pylist()]
            yield s.rows.filter(pa.array([not (h and 20 * h >= n) for h, n in zip(hit, found.column("n_words").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the benchmark's passages make up a twentieth or more go. Each is judged by its own text: null and
    empty ones stay, repeated rows fare alike, ids do not matter; no rows, or no benchmark, change nothing."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
