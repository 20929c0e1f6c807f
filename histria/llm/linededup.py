"""Line deduplication by a segment-partition edit join (operator 6).

Two lines within `tau` edits (insert, delete, replace one code point) have, when one is cut into tau + 1 segments, at
least one segment that is a substring of the other at a nearby place. Each distinct line therefore enters an index by
its segments (with its length) and probes it, for every length up to tau shorter, with the few substrings that can
match. Lines that meet are compared by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, drop_tables, materialize, small, table, tiles

TAU = 2
#: Shorter lines are no part of the edit join (two edits would make most of them equal); only their exact copies count.
MIN_CHARS = 24
LIST = 32
TILE = 1200
_ENTRY = np.dtype([("s", "<u4"), ("k", "<i8"), ("f", "u1")])
INDEX, PROBE = 1, 2
_BASE = 0xA24BAED4963EE407
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _value(cp: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(cp * np.uint64(0x9FB21C651E98DF25) + np.uint64(salt))


_BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_LOW, _LOW2 = (_value(np.arange(1 << 14, dtype=np.uint64), salt) for salt in (1, 2))


class Lines:
    """The lines of a slice as code points, with prefix hashes for any substring."""

    def __init__(self, s: K.Slice):
        first = (s.data & 0xC0) != 0x80
        self.cp = np.frombuffer(s.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        off = np.r_[0, np.cumsum(first)][s.off]
        ends = np.flatnonzero(self.cp == 10)
        # A text of k line ends has k + 1 lines.
        self.start = np.sort(np.concatenate([off[:-1], ends + 1]))
        self.end = np.sort(np.concatenate([ends, off[1:]]))
        self.off = np.r_[0, np.cumsum(np.diff(np.searchsorted(ends, off)) + 1)]
        self.doc = K.segments_of(self.off)
        self.number = np.arange(len(self.start)) - self.off[:-1][self.doc]
        self.n = self.end - self.start

    @cached_property
    def c(self) -> np.ndarray:
        c = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum(self._values(_LOW, 1) * K.powers(_BASE, len(self.cp)), out=c[1:])
        return c

    def blank(self, at: np.ndarray) -> np.ndarray:
        """Which of these lines are of white space only, or of nothing."""
        off = np.r_[0, np.cumsum(self.n[at])]
        ink = np.r_[0, np.cumsum(~np.isin(self.cp[K.ragged(self.start[at], self.n[at])], _BLANK))]
        return ink[off[1:]] == ink[off[:-1]]

    def _values(self, known: np.ndarray, salt: int) -> np.ndarray:
        if not len(self.cp) or self.cp.max() < len(known):
            return known[self.cp]
        return _value(self.cp.astype(np.uint64), salt)

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.c[b] - self.c[a]) * K.powers(_BASE_INV, len(self.c))[a]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each line (the second of other values of its code points)."""
        h = self.raw(self.start, self.end)
        d = np.zeros(len(self.cp) + 1, np.uint64)
        np.cumsum(self._values(_LOW2, 2) * K.powers(_BASE, len(self.cp)), out=d[1:])
        g = (d[self.end] - d[self.start]) * K.powers(_BASE_INV, len(self.c))[self.start]
        n = self.n.astype(np.uint64)
        return K.mix(h ^ n).view(np.int64), K.mix(g + n).view(np.int64)


def cuts(length: np.ndarray | int, tau: int, i: int) -> tuple:
    """(start, end) of segment i of tau + 1 nearly equal ones; the later ones are the longer."""
    base, extra = length // (tau + 1), length % (tau + 1)
    longer = i - (tau + 1 - extra)
    start = i * base + (longer * (longer > 0))
    return start, start + base + (longer >= 0)


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): a line of length n probes segment i of lines of length n - d, `shift` code points beyond its place."""
    out = []
    for d in range(tau + 1):
        for i in range(tau + 1):
            for shift in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1):
                out.append((d, i, shift))
    return out


def entries(lines: Lines, at: np.ndarray, key: np.ndarray, tau: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    n, start = lines.n[at], lines.start[at]
    hashes, flags, keys = [], [], []
    for d, i, shift in probes(tau):
        a, b = cuts(n - d, tau, i)
        tag = ((n - d) * (tau + 1) + i).astype(np.uint64)
        h = K.mix(lines.raw(start + np.maximum(a + shift, 0), start + np.minimum(b + shift, n)) + K.mix(tag))
        ok = (a + shift >= 0) & (b + shift <= n)
        hashes.append(h[ok])
        keys.append(key[at][ok])
        flags.append(np.full(int(ok.sum()), (INDEX | PROBE) if d == 0 and shift == 0 else PROBE, np.uint8))
    h = np.concatenate(hashes)
    rec = np.empty(len(h), _ENTRY)
    rec["s"], rec["k"], rec["f"] = h & np.uint64(0xFFFFFFFF), np.concatenate(keys), np.concatenate(flags)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), rec


_LINES = "doc_id long, text_hash long, line int, chars int, key long, key2 long"
_DEALT = "bucket int, blob binary"


def scan(docs: DataFrame, min_chars: int, short: bool) -> DataFrame:
    """Every line of at least min_chars code points, and with `short` every shorter one that is not blank."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            x = Lines(s)
            key, key2 = x.keys()
            at = np.flatnonzero(x.n >= min_chars)
            if short:
                less = np.flatnonzero(x.n < min_chars)
                at = np.union1d(at, less[~x.blank(less)])
            doc = pa.array(x.doc[at])
            yield pa.RecordBatch.from_arrays([s.rows.column(0).take(doc), s.rows.column(1).take(doc), pa.array(x.number[at].astype(np.int32)), pa.array(x.n[at].astype(np.int32)), pa.array(key[at]), pa.array(key2[at])], [c.split()[0] for c in _LINES.split(", ")])

    return docs.mapInArrow(run, _LINES)


def deal(docs: DataFrame, tau: int, min_chars: int, buckets: int) -> DataFrame:
    """As blobs, the index and probe entries of the lines of at least min_chars code points that are new to a task. They
    are several times the lines' size, so they are read where they are made and not written as a table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            bucket, rec = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket, rec = bucket[order], rec[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array([r.tobytes() for r in np.split(rec, first[1:])], pa.binary())], ["bucket", "blob"])

        for s in K.text_slices(it, "text"):
            x = Lines(s)
            key, _ = x.keys()
            at = np.flatnonzero(x.n >= min_chars)
            _, firsts = np.unique(key[at], return_index=True)
            at = at[np.sort(firsts)]
            at = at[np.array([k not in seen for k in key[at].tolist()], bool)]
            seen.update(key[at].tolist())
            if len(at):
                held.append(entries(x, at, key, tau, buckets))
                size += len(held[-1][1])
            if size >= 400_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, _DEALT)


def meet(dealt: DataFrame, long_list: int) -> DataFrame:
    """a, b: lines of which one's segment meets the other's probe. Lists longer than long_list are tied to their first line."""

    def run(t: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_py(), _ENTRY) for x in t.column("blob")])
        rec = rec[np.lexsort((rec["k"], rec["s"]))]
        new = np.r_[True, (rec["s"][1:] != rec["s"][:-1]) | (rec["k"][1:] != rec["k"][:-1])]
        first = np.flatnonzero(new)
        f = np.bitwise_or.reduceat(rec["f"], first)
        s, k = rec["s"][first], rec["k"][first]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count = np.diff(np.r_[head, len(s)])
        # A list without an index entry links nothing.
        live = (count > 1) & ((np.bitwise_or.reduceat(f, head) & INDEX) > 0)
        run_of = np.repeat(np.arange(len(head)), count)
        listed = np.repeat(live & (count <= long_list), count)
        out = []
        for d in range(1, long_list):
            i = np.flatnonzero(listed[: len(s) - d] & (run_of[: len(s) - d] == run_of[d:])) if len(s) > d else np.zeros(0, int)
            if not len(i):
                break
            i = i[((f[i] & INDEX) > 0) | ((f[i + d] & INDEX) > 0)]
            out.append((k[i], k[i + d]))
        far = np.flatnonzero(np.repeat(live & (count > long_list), count))
        out.append((k[head[run_of[far]]], k[far]))
        a, b = (np.concatenate(x) for x in zip(*out))
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        one = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        return pa.table({"a": pa.array(a[one]), "b": pa.array(b[one])})

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def within(a: np.ndarray, b: np.ndarray, tau: int) -> bool:
    """Edit distance of two code-point arrays at most tau. Bit d + tau of level[e]: with e edits, the prefix of a read so
    far can be turned into the prefix of b that is d longer; all 2 tau + 1 diagonals advance in one step."""
    if abs(len(a) - len(b)) > tau:
        return False
    m = min(len(a), len(b))
    unequal = np.flatnonzero(a[:m] != b[:m])
    p = int(unequal[0]) if len(unequal) else m
    unequal = np.flatnonzero(a[len(a) - m + p :][::-1] != b[len(b) - m + p :][::-1])
    q = int(unequal[0]) if len(unequal) else m - p
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= tau
    full = (1 << (2 * tau + 1)) - 1
    equal = np.zeros(len(a), np.int64)
    for d in range(-tau, tau + 1):
        i0, i1 = max(0, -d), min(len(a), len(b) - d)
        if i1 > i0:
            equal[i0:i1] |= (a[i0:i1] == b[i0 + d : i1 + d]).astype(np.int64) << (d + tau)
    level = [0] * (tau + 1)
    for e in range(tau + 1):
        level[e] = sum(1 << (d + tau) for d in range(e + 1)) & full
    for hit in equal.tolist():
        last = level
        level = []
        for e in range(tau + 1):
            x = last[e] & hit
            if e:
                x |= last[e - 1] | (last[e - 1] >> 1) | (level[e - 1] << 1)
            level.append(x & full)
        if not level[tau]:
            return False
    return bool(level[tau] >> (len(b) - len(a) + tau) & 1)


def link_lines(key: np.ndarray, texts: list[np.ndarray], tau: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join lines not yet connected. cross: block of each line; only lines of different blocks are compared."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), key[i]))
    root = np.arange(len(texts))
    index: dict[tuple, list[int]] = {}
    plan, out = probes(tau), []
    for y in order:
        raw, n = texts[y].tobytes(), len(texts[y])
        tried = set()
        for d, i, shift in plan:
            a, b = cuts(n - d, tau, i)
            if a + shift < 0 or b + shift > n:
                continue
            for x in index.get((n - d, i, raw[4 * (a + shift) : 4 * (b + shift)]), ()):
                if x in tried or root[x] == root[y] or (cross is not None and cross[x] == cross[y]):
                    continue
                tried.add(x)
                if within(texts[x], texts[y], tau):
                    out.append((int(key[x]), int(key[y])))
                    root[root == root[y]] = root[x]
        for i in range(tau + 1):
            a, b = cuts(n, tau, i)
            index.setdefault((n, i, raw[4 * a : 4 * b]), []).append(y)
    return out


def near_lines(docs: DataFrame, dealt: DataFrame, classes: DataFrame, tau: int, long_list: int, tile: int) -> DataFrame:
    """node, component over line keys."""
    clusters = components(meet(dealt, long_list))
    members = classes.join(clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")), "key").select("cluster", "key", "key2", "chars", "first")
    members = materialize(members, "members")
    wanted = members.groupBy("first.doc_id", "first.text_hash").agg(F.collect_set("first.line").alias("lines"))
    wanted = small(materialize(wanted, "wanted"), 40, ("lines",))

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            x = Lines(s)
            at = np.concatenate([x.off[i] + np.array(sorted(y), np.int64) for i, y in enumerate(s.rows.column("lines").to_pylist())])
            k1, k2 = x.keys()
            yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array([x.cp[a:b].tobytes() for a, b in zip(x.start[at], x.end[at])], pa.binary())], ["key", "key2", "cps"])

    def link(t: pa.Table) -> pa.Table:
        got: dict[tuple[int, int], tuple[str, np.ndarray]] = {}
        for k, k2, b, x in zip(*(t.column(c).to_pylist() for c in ("key", "key2", "block", "cps"))):
            got.setdefault((k, k2), (b, np.frombuffer(x, np.uint32)))
        cross = np.array([b for b, _ in got.values()], object) if t.column("bi")[0].as_py() != t.column("bj")[0].as_py() else None
        found = link_lines(np.array([k for k, _ in got], np.int64), [x for _, x in got.values()], tau, cross)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & docs["text_hash"].eqNullSafe(wanted["text_hash"]))
    lines = found.select("text", "lines").mapInArrow(texts, "key long, key2 long, cps binary")
    placed = tiles(members.drop("first"), tile, F.floor(F.col("chars") / 8).cast("int"), -(-tau // 8), "key")
    links = placed.join(lines, ["key", "key2"]).groupBy("cluster", "bi", "bj").applyInArrow(link, "a long, b long")
    return components(links)


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, long_list: int = LIST, tile: int = TILE, short: bool = False) -> DataFrame:
    """row (all columns of docs, as a struct), n_lines, n_removed (long) and kept: the text without its repeated lines.

    Lines (between line ends) of at least min_chars code points are one class when they are equal or linked by pairs
    within tau edits; of a class the first occurrence by (doc_id, text hash, line number) stays and the others go, with
    one line end each. Shorter lines stay or, with `short`, are one class when they are equal; blank ones stay. A null text has no lines and stays null; an empty one has one empty line.
    Rows of equal id and equal text count as one document (each keeps what the first keeps); a null id comes first in
    the order. No rows give no rows; further columns are carried in `row` whatever their names.
    """
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    t = t.withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("text", F.col("row.text")).withColumn("text_hash", F.xxhash64("text"))
    plain = t.select("doc_id", "text_hash", "text")
    # About 4 MB of text a bucket.
    buckets = 1 + (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 << 20)
    seen = materialize(scan(plain, min_chars, short), "lines")
    dealt = deal(plain, tau, min_chars, int(buckets))
    classes = materialize(seen.groupBy("key", "key2").agg(F.first("chars").alias("chars"), F.min(F.struct("doc_id", "text_hash", "line")).alias("first"), F.count("*").alias("cnt")), "classes")
    near = near_lines(plain, dealt, classes, tau, long_list, tile)
    named = classes.join(near.withColumnRenamed("node", "key"), "key", "left").withColumn("near", F.col("component").isNotNull())
    named = materialize(named.withColumn("component", F.coalesce("component", "key")), "named")
    drop_tables(classes)
    # A hot component is combined in the tasks before its least occurrence is shuffled.
    groups = named.where("near").groupBy("component").agg(F.min("first").alias("best"))
    best = named.join(groups, "component", "left").select("key", "key2", F.coalesce("best", "first").alias("best"), "cnt", "near")
    several = materialize(best.where("cnt > 1 or near").select("key", "key2", "best"), "several")
    drop_tables(named)
    gone = seen.join(several, ["key", "key2"]).where(~F.struct("doc_id", "text_hash", "line").eqNullSafe(F.col("best")))
    gone = materialize(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone")), "gone")
    drop_tables(seen, several)
    gone = small(gone, 40, ("gone",))
    both = t.drop("text").join(gone, t["doc_id"].eqNullSafe(gone["doc_id"]) & t["text_hash"].eqNullSafe(gone["text_hash"]), "left").select("row", "gone")
    lines = F.split("row.text", "\n", -1)

    def without(x):
        places = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(places, lambda i: F.get(x["lines"], i)), "\n")

    # The array of one struct splits the text once; the rest is linear in the lines, however many of them go.
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.transform(F.array(F.struct(lines.alias("lines"), "gone")), without)[0])
    return both.select("row", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), short=True)
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("kept_chars"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing but white space is left goes."""
    out = dedup_lines(docs, short=True).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"(?U)\S"))
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])
