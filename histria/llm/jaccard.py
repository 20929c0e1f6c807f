"""N-gram Jaccard join: documents that share most of their word shingles, and the groups they form (operator 1).

1. A scan gives each text's set size, a 128-bit digest of the set, a hashed bitmap signature, and the shingles that are
   frequent within stretches of the input. Equal sets form a class; from here on a class is one node.
2. Any two sets with Jaccard >= t share one of the first n - ceil(t n) + 1 shingles in any common order. The order here
   puts frequent shingles last. A second scan deals these prefixes to buckets.
3. In a bucket, nodes that share a shingle become candidate pairs. Where a shingle's list is long, the sets with such
   shingles in their prefixes are dealt once more with these put last too; nodes of lists that are long even then are
   tied together per size band without naming pairs. Pairs whose bitmaps bound the overlap too low are dropped.
4. The candidate graph's components are cut into size-banded tiles of bounded size. A tile holds its sets as sorted
   arrays, skips pairs by size and by bitmap bound, and intersects the rest exactly; it returns each set's number of
   links and enough links to connect what they connect, never all pairs.
5. Components over the found links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, materialize, numbers, small, table, tiles

SHINGLE = 5
PERCENT = 75
#: How many frequent shingles the order knows. They are only put last: more or fewer change cost, never results.
FREQUENT = 1 << 16
#: How many long lists' shingles are put last at once; if there are more, that is done for one block of them after the other.
HOT_BLOCK = 1 << 20
FREQUENT_LOCAL = 6
FLUSH = 2_000_000
BUCKET_POSTINGS = 256_000
LIST = 32
TILE = 1200
_POSTING = np.dtype([("s", "<u4"), ("k", "<i8"), ("b", "u1")])
_BANDS = 4  # size bands per factor 1 / t


def band_of(n: np.ndarray, percent: int) -> np.ndarray:
    """A size class; linked sets are at most _BANDS + 1 classes apart. (All sets of over 10**7 shingles are the last class.)"""
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / math.log(100 / percent) * _BANDS), 255).astype(np.int64)


def shingle_sets(s: K.Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and offsets. Fewer words: all of them are one shingle."""
    w = K.words(s.data, s.off, K.SPACED)
    n = np.diff(w.off)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    off = np.r_[0, np.cumsum(count)]
    out = np.empty(int(off[-1]), np.uint64)
    acc = w.h
    for m in range(1, size + 1):
        acc = acc if m == 1 else K.grow(acc, w.h, m)
        mine = np.flatnonzero(n == m) if m < size else np.flatnonzero(n >= size)
        if len(mine):
            out[K.ragged(off[:-1][mine], count[mine])] = K.mix(acc[K.ragged(w.off[:-1][mine], count[mine])] + np.uint64(m))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[off[:-1][count > 0]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][off]


def digests(v: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c1 = np.r_[np.uint64(0), np.cumsum(K.mix(v ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
    c2 = np.r_[np.uint64(0), np.cumsum(K.mix(v + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)]
    n = np.diff(off).astype(np.uint64)
    return K.mix(c1[off[1:]] - c1[off[:-1]] + n).view(np.int64), K.mix(c2[off[1:]] - c2[off[:-1]] ^ n).view(np.int64)


def bitmap(v: np.ndarray) -> np.ndarray:
    """Parity bitmap: shingle x flips bit x mod size. Bits in which two bitmaps differ count no more than elements in which the sets do."""
    bits = 1 << max(6, int(len(v) - 1).bit_length())
    return np.packbits((np.bincount((v % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    while b.shape[-1] > words:
        h = b.shape[-1] // 2
        b = b[..., :h] ^ b[..., h:]
    return b


def may_link(a: int, b, differ, percent: int):
    """Upper bound of the overlap from sizes and bit counts: |A & B| <= min(a, b) and 2 |A & B| <= a + b - differ."""
    inter = np.minimum((a + b - differ) // 2, np.minimum(a, b))
    return 100 * inter >= percent * (a + b - inter)


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def prefix_mask(hot: np.ndarray, off: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of each text, in the order of their hashes with the hot ones last."""
    n = np.diff(off)
    length = n - -(-n * percent // 100) + 1
    doc = K.segments_of(off)
    c = np.r_[0, np.cumsum(~hot)]
    cold_before = c[:-1] - c[off[:-1]][doc]
    cold = (c[off[1:]] - c[off[:-1]])[doc]
    rank = np.where(hot, cold + np.arange(len(hot)) - off[:-1][doc] - cold_before, cold_before)
    return rank < length[doc]


def list_id(v: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | low bits: what tells lists of postings apart (shingles that share one only add candidates)."""
    return ((v >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (v & np.uint64(0xFFFFFFFF))


_SCAN = "doc_id long, n long, key long, key2 long, bits binary, frequent long, cnt long"
DIGEST = "digest"


def digest():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def scan(docs: DataFrame, told: bool = False) -> DataFrame:
    """told: also each text's digest."""
    names = [x.split()[0] for x in _SCAN.split(", ")] + [DIGEST] * told

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            v, c = v[c >= FREQUENT_LOCAL].view(np.int64), c[c >= FREQUENT_LOCAL]
            none = pa.nulls(len(v), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(v), pa.binary()), pa.array(v), pa.array(c), *[pa.nulls(len(v), pa.string())] * told], names)

        for s in K.text_slices(it, "text"):
            v, off = shingle_sets(s)
            k1, k2 = digests(v, off)
            bits = []
            for k, a, b in zip(k1.tolist(), off[:-1].tolist(), off[1:].tolist()):
                bits.append(bitmap(v[a:b]).tobytes() if b > a and k not in seen else None)
                if b > a and k not in seen:
                    seen.add(k)
                    held.append(v[a:b])
                    size += b - a
            none = pa.nulls(len(k1), pa.int64())
            yield pa.RecordBatch.from_arrays([s.rows.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(k1), pa.array(k2), pa.array(bits, pa.binary()), none, none, *s.rows.columns[2:]], names)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[digest().alias(DIGEST)] * told)
    return slim.mapInArrow(run, _SCAN + f", {DIGEST} string" * told)


def postings(docs: DataFrame, frequent: np.ndarray, buckets: int, percent: int, long_lists: np.ndarray | None = None) -> DataFrame:
    """bucket, blob: prefixes of the sets that are new to a task. With long_lists (ids, sorted): only of sets of which
    the prefix has a shingle of these lists, and with these shingles put last as well."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, long_lists))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, long_lists = shared.value
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, rec = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            bucket, rec = ids[order], rec[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([x.tobytes() for x in np.split(rec, first[1:])], pa.binary())], ["bucket", "blob"])

        for s in K.text_slices(it, "text"):
            v, off = shingle_sets(s)
            k1, _ = digests(v, off)
            new = np.zeros(len(k1), bool)
            for i, (k, some) in enumerate(zip(k1.tolist(), np.diff(off) > 0)):
                if some and k not in seen:
                    seen.add(k)
                    new[i] = True
            doc = K.segments_of(off)
            hot, ids = among(frequent, v), list_id(v, buckets)
            take = prefix_mask(hot, off, percent)
            if long_lists is not None:
                long = among(long_lists, ids)
                new &= np.bincount(doc[take & long], minlength=len(k1)) > 0
                take = prefix_mask(hot | long, off, percent)
            take &= new[doc]
            rec = np.empty(int(take.sum()), _POSTING)
            rec["s"], rec["k"], rec["b"] = ids[take] & np.uint64(0xFFFFFFFF), k1[doc[take]], band_of(np.diff(off), percent)[doc[take]]
            if len(rec):
                held.append(((ids[take] >> np.uint64(32)).astype(np.int64), rec))
                size += len(rec)
            if size >= 400_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


PAIR, TIE, LONG = 0, 1, 2


def candidates(posted: DataFrame, long_list: int, tie: bool) -> DataFrame:
    """a, b, kind. PAIR: nodes that share a prefix shingle. Of a list longer than long_list either its id (LONG) or, if
    tie, edges to and between the leaders of its size bands (TIE), which hold its nodes together without naming pairs."""

    def run(t: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_py(), _POSTING) for x in t.column("blob")])
        rec = rec[np.lexsort((rec["k"], rec["b"], rec["s"]))]
        same = (rec["s"][1:] == rec["s"][:-1]) & (rec["k"][1:] == rec["k"][:-1])
        rec = rec[np.r_[True, ~same]]
        s, k, b = rec["s"], rec["k"], rec["b"].astype(np.int64)
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count = np.diff(np.r_[first, len(s)])
        run_of = np.repeat(np.arange(len(first)), count)
        listed = np.repeat((count > 1) & (count <= long_list), count)
        edges = []
        for d in range(1, long_list):
            i = np.flatnonzero(listed[: len(s) - d] & (run_of[: len(s) - d] == run_of[d:])) if len(s) > d else np.zeros(0, int)
            if not len(i):
                break
            edges.append(_distinct(k[i], k[i + d], b[i + d] - b[i] <= _BANDS + 1, PAIR))
        long = np.flatnonzero(count > long_list)
        if len(long) and not tie:
            ids = (t.column("bucket")[0].as_py() << 32) + s[first[long]].astype(np.int64)
            edges.append(pa.table({"a": pa.array(ids), "b": pa.array(count[long]), "kind": pa.array(np.full(len(long), LONG, np.int32))}))
        far = np.flatnonzero(np.repeat(count > long_list, count))
        if len(far) and tie:
            lead = np.r_[True, (run_of[far][1:] != run_of[far][:-1]) | (b[far][1:] != b[far][:-1])]
            leader = far[lead][np.cumsum(lead) - 1]
            edges.append(_distinct(k[leader], k[far], np.ones(len(far), bool), TIE))
            heads = far[lead]
            near = (run_of[heads][1:] == run_of[heads][:-1]) & (b[heads][1:] - b[heads][:-1] <= _BANDS + 1)
            edges.append(_distinct(k[heads[:-1]], k[heads[1:]], near, TIE))
        if not edges:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "kind": pa.array([], pa.int32())})
        return pa.concat_tables(edges)

    return posted.groupBy("bucket").applyInArrow(run, "a long, b long, kind int")


def _distinct(a: np.ndarray, b: np.ndarray, ok: np.ndarray, kind: int) -> pa.Table:
    a, b = np.minimum(a, b)[ok & (a != b)], np.maximum(a, b)[ok & (a != b)]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return pa.table({"a": pa.array(a[new]), "b": pa.array(b[new]), "kind": pa.array(np.full(int(new.sum()), kind, np.int32))})


def bounded_by_bits(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ba, bb) whose bitmaps leave a link possible."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            keep = []
            for na, nb, x, y in zip(*(t.column(c).to_pylist() for c in ("na", "nb", "ba", "bb"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                keep.append(bool(may_link(na, nb, int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum()), percent)))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def link_tile(key: np.ndarray, sets: list[np.ndarray], block: np.ndarray, cross: bool, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that join sets not connected before, number of links of each set): over all pairs of one block, or of two
    blocks if cross. Pairs out of size or bitmap bounds are never intersected."""
    order = np.lexsort((key, [len(x) for x in sets]))
    key, block, sets = key[order], block[order], [sets[i] for i in order]
    n = np.array([len(x) for x in sets])
    off = np.r_[0, np.cumsum(n)]
    # Sorted arrays over the tile's own dense numbering: an intersection is a look-up of one array in the other's marks.
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(len(values), bool)
    words = max(1, min(1 << max(0, int(n.max() - 1).bit_length() - 6), 64))
    bits = np.stack([_small_bitmap(x, words) for x in sets])
    root, counts, out = np.arange(len(sets)), np.zeros(len(sets), np.int64), []
    hi = np.searchsorted(n, n * 100 // percent, "right")
    for i in range(len(sets)):
        j = np.arange(i + 1, hi[i])
        if cross:
            j = j[block[j] != block[i]]
        j = j[may_link(n[i], n[j], np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64), percent)] if len(j) else j
        if not len(j):
            continue
        mine = flat[off[i] : off[i + 1]]
        marks[mine] = True
        inter = np.add.reduceat(marks[flat[K.ragged(off[j], n[j])]], np.r_[0, np.cumsum(n[j])[:-1]], dtype=np.int64)
        marks[mine] = False
        j = j[100 * inter >= percent * (n[i] + n[j] - inter)]
        counts[i] += len(j)
        counts[j] += 1
        for k in j.tolist():
            if root[k] != root[i]:
                out.append((int(key[i]), int(key[k])))
                root[root == root[k]] = root[i]
    back = np.empty_like(counts)
    back[order] = counts
    return out, back


def _small_bitmap(v: np.ndarray, words: int) -> np.ndarray:
    bits = 64 * words
    return np.packbits((np.bincount((v % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, tile: int = TILE, long_list: int = LIST) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links: one row per row of docs.

    Two documents link when 100 |A & B| >= percent |A | B| over their distinct 5-word shingles (64-bit hashes of words
    `[^\\x20\\x09-\\x0D]+` with A-Z lowered); component_id is the smallest doc_id reachable by links,
    class_id the smallest with an equal set, n_links the number of other sets (classes) linked with it. Fewer than five
    words: the whole sequence is one shingle. Null or empty texts, or without words, have an empty set and link with
    nothing. Repeated rows and equal texts fall in one class and meet no pair work; a row with null doc_id links like any
    other but is nobody's smallest id (alone, its component is null). No rows give no rows; extra columns are ignored.
    """
    out = grouped(docs, percent, tile, long_list)
    own = lambda c: F.when(F.col("n_shingles") > 0, F.coalesce(c, "doc_id")).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", "n_shingles", own("component_id"), own("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def grouped(docs: DataFrame, percent: int = PERCENT, tile: int = TILE, long_list: int = LIST, told: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links of each row, the latter ones null for sets without copies or
    links; told: also component (a number, null likewise, of the group even if no row of it has an id) and the text's digest."""
    rows = materialize(scan(docs, told), "scan")
    of_doc = rows.where("key is not null").select("doc_id", "n", "key", "key2", *[DIGEST] * told)
    top = rows.where("frequent is not null").groupBy("frequent").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "frequent").limit(FREQUENT)
    frequent = numbers(top.select("frequent"))
    classes = of_doc.where("n > 0").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    total = classes.agg(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    buckets = max(1, -(-int(total) // BUCKET_POSTINGS))
    met = materialize(candidates(postings(docs, frequent, buckets, percent), long_list, tie=False), "met")
    pairs = met.where(F.col("kind") == PAIR)
    long = met.where(F.col("kind") == LONG).select("a").distinct()
    blocks = -(-long.count() // HOT_BLOCK)
    for k in range(blocks):
        ids = numbers(long.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == k))
        again = candidates(postings(docs, frequent, buckets, percent, ids), long_list, tie=True)
        pairs = pairs.unionByName(materialize(again, "met"))
    pairs = materialize(pairs.groupBy("a", "b").agg((F.max("kind") == TIE).alias("tie")), "pairs")
    bits = rows.where("bits is not null").groupBy("key", "n").agg(F.first("bits").alias("bits"))
    ends = pairs.where("not tie").join(bits.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    ends = ends.join(bits.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    kept = bounded_by_bits(ends.select("a", "b", "na", "nb", "ba", "bb"), percent)
    clusters = components(kept.unionByName(pairs.where("tie").select("a", "b")))
    members = classes.join(clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")), "key")
    members = materialize(members.select("cluster", "key", "key2", "rep", "n"), "members")
    # A null id stands for the classes that no row with an id is in.
    wanted = small(members.select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def arrays(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            v, off = shingle_sets(s)
            k1, k2 = digests(v, off)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([v[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["key", "key2", "shingles"])

    def link(t: pa.Table) -> pa.Table:
        seen, block, key, sets = set(), [], [], []
        for k, k2, b, x in zip(*(t.column(c).to_pylist() for c in ("key", "key2", "block", "shingles"))):
            if (k, k2) not in seen:
                seen.add((k, k2))
                block.append(b)
                key.append(k)
                sets.append(np.frombuffer(x, np.uint64))
        cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        found, counts = link_tile(np.array(key, np.int64), sets, np.array(block, object), cross, percent)
        some = counts > 0
        a = np.concatenate([np.array([x for x, _ in found], np.int64), np.array(key, np.int64)[some]])
        b = pa.array([y for _, y in found] + [None] * int(some.sum()), pa.int64())
        return pa.table({"a": pa.array(a), "b": b, "links": pa.array([0] * len(found) + counts[some].tolist(), pa.int64())})

    sets = texts.mapInArrow(arrays, "key long, key2 long, shingles binary")
    links = tiles(members, tile, F.floor(F.ln("n") / math.log(100 / percent) * _BANDS).cast("int"), _BANDS + 1, "key").join(sets, ["key", "key2"]).groupBy("cluster", "bi", "bj").applyInArrow(link, "a long, b long, links long")
    links = materialize(links, "links")
    found = components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    named = classes.join(found.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = materialize(named.where("copies > 1 or n_links > 0"), "named")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    named = named.select("key", "key2", "component_id", "n_links", F.col("rep").alias("class_id"), *["component"] * told)
    return of_doc.withColumnRenamed("n", "n_shingles").join(named, ["key", "key2"], "left").drop("key", "key2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id (null ids last; of one id, that with the
    smallest digest of its text); empty texts are no copies of each other. Rows are told apart by id and text."""
    groups = grouped(docs, told=True).where("n_shingles > 0 and component is not null")
    texts = groups.groupBy("component", "doc_id", DIGEST).agg(F.count("*").alias("c"))
    texts = materialize(texts.withColumn("at", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", DIGEST)), "texts")
    best = texts.groupBy("component").agg(F.min("at").alias("best"))
    # Groups of one text and id that is there once drop nothing.
    marked = texts.join(best, "component").select(F.col("doc_id").alias("id_"), F.col(DIGEST).alias("digest_"), (F.col("at") == F.col("best")).alias("stays"), "c")
    marked = materialize(marked.where("not stays or c > 1"), "marked")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (digest() == F.col("digest_"))
    out = docs.join(small(marked.select("id_", "digest_"), 88), same, "left_anti")
    repeated = marked.where("stays").select("id_", "digest_")
    if repeated.isEmpty():
        return out
    return out.unionByName(docs.join(small(repeated, 88), same, "left_semi").dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT doc_id, sha256(string_agg(g, chr(1) ORDER BY g)) AS k FROM s GROUP BY doc_id)),
l AS (SELECT a AS doc_id, count(DISTINCT y.class_id) AS n_links FROM links JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE x.class_id <> y.class_id GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(reach.b), d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n, c.class_id, l.n_links
"""
