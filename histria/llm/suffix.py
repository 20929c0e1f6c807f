"""Suffix-array deduplication of long repeated strings, block by block with a difference cover (operator 9).

A string of `length` bytes is represented by its anchor, the leftmost smallest hash of its GRAM-byte grams. Equal
strings have equal anchors at equal places in them, so all suffixes that can share `length` bytes meet in the block of
their anchor, and a suffix whose anchor occurs nowhere else is never sorted. Inside a block the contexts of the anchors
are laid out in rows with the anchor in one column. Suffixes are sorted one suffix bucket (one column) at a time: by
their first V bytes, and where these tie by the ranks of difference-cover sample suffixes, computed beforehand by
doubling. As rows are aligned, tied suffixes have one residue modulo V, so one look at the cover serves all of them.
Neighbours in that order that agree in `length` bytes are repeats.

No anchor makes its block large. A task that meets an anchor three times knows that it is repeated: two of the places go
to the block, with the number of the others, which go past it. Contexts of an anchor with over HOT places are cut into
bands of BAND suffix buckets; equal pieces are merged by 128-bit digests, in tasks and then between them, and pieces meet
in a bucket only if all bytes that every suffix of the band covers are equal. A bucket of over HOT different pieces is cut
once more, into single suffixes, where equal ones are again merged by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import digest_sum, materialize, numbers, small, table

LENGTH = 200
GRAM = 32
V = 32
#: Bytes of text whose anchors, on average, fall into one block.
BLOCK_BYTES = 4 << 20
#: Places of one anchor, or different pieces of one bucket, that a block takes; of more, it is cut finer.
HOT = 20_000
#: Anchors cut finer, those with most places first: no other has more than this part of all places.
HOT_ANCHORS = 1 << 20
#: Suffix buckets of a piece of a hot anchor's context.
BAND = 32
BLOCK_PIECES = 40_000
#: Instead of a place: the number of places (in k) that went past the block.
_PAST = 0xFFFFFFFF
_PLACE = np.dtype([("k", "<i8"), ("p", "<i8")])
_ANCHOR = np.dtype([("s", "<u4"), ("k", "<i8"), ("p", "<u4"), ("x0", "u1"), ("x1", "u1")])


def difference_cover(v: int) -> list[int]:
    """Residues whose pairwise differences are all residues, chosen greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = lambda r: len({(r - c) % v for c in cover} | {(c - r) % v for c in cover} & missing)
        best = max((r for r in range(v) if r not in cover), key=lambda r: (len(({(r - c) % v for c in cover} | {(c - r) % v for c in cover}) & missing), -gain(r), -r))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(V)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor, its hash, first and last start of the strings it stands for), places in data."""
    n = len(data) - GRAM + 1
    if n < 1 or len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, z
    c = K.byte_prefix(data, False)
    at = np.arange(n)
    h = K.span_hash(c, at, at + GRAM)
    low = K.sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - GRAM + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = K.ragged(off[:-1], np.maximum(np.diff(off) - length + 1, 0))
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, z
    a = anchor[starts]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:], len(a)] - 1
    p = a[first]
    return np.searchsorted(off, p, "right") - 1, p, h[p], starts[first], starts[last]


def post(docs: DataFrame, blocks: int, length: int) -> DataFrame:
    """block, part, blob: the anchors of the texts (key, text) that are new to a task. Part 0 has to meet in its block; the
    other parts are anchors known to be repeated."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = 1 + TaskContext.get().partitionId()
        seen: set[tuple[int, int]] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            block, rec = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((rec["s"], block))
            block, rec = block[order], rec[order]
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (rec["s"][1:] != rec["s"][:-1])])
            count = np.diff(np.r_[first, len(rec)])
            third = np.arange(len(rec)) - np.repeat(first, count) >= 2
            told = rec[first[count > 2]]
            told["k"], told["p"] = count[count > 2] - 2, _PAST
            block, rec = np.concatenate([block, block[first[count > 2]]]), np.concatenate([rec, told])
            part = np.concatenate([np.where(third, past, 0), np.zeros(len(told), np.int64)])
            order = np.lexsort((part, block))
            block, part, rec = block[order], part[order], rec[order]
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(part[first].astype(np.int32)), pa.array([r.tobytes() for r in np.split(rec, first[1:])], pa.binary())], ["block", "part", "blob"])

        for s in K.text_slices(it, "text"):
            key = s.rows.column(0).to_numpy()
            whole = K.span_hash(K.byte_prefix(s.data, False), s.off[:-1], s.off[1:])
            new = np.zeros(len(key), bool)
            for i, x in enumerate(zip(key.tolist(), whole.tolist())):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            doc, p, h, lo, hi = (x for x in anchors(s.data, s.off, length))
            take = new[doc]
            doc, p, h, lo, hi = doc[take], p[take], h[take], lo[take], hi[take]
            rec = np.empty(len(p), _ANCHOR)
            rec["s"], rec["k"], rec["p"], rec["x0"], rec["x1"] = h & np.uint64(0xFFFFFFFF), key[doc], p - s.off[doc], p - lo, p - hi
            if len(rec):
                held.append((((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), rec))
                size += len(rec)
            if size >= 300_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "block int, part int, blob binary")


def repeated_anchors(posted: DataFrame, hot: int = HOT) -> DataFrame:
    """block, key, anchors (s, p, x0, x1 as one blob of records): those that occur at two places or more; and, without key,
    anchor (block << 32 | s) and places of those with over `hot` places."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        rec = np.concatenate([np.frombuffer(x.as_py(), _ANCHOR) for x in t.column("blob")])
        past, rec = rec[rec["p"] == _PAST], rec[rec["p"] != _PAST]
        rec = rec[np.lexsort((rec["p"], rec["k"], rec["s"]))]
        rec = rec[np.r_[True, (rec["s"][1:] != rec["s"][:-1]) | (rec["k"][1:] != rec["k"][:-1]) | (rec["p"][1:] != rec["p"][:-1])]]
        many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if t.column("part")[0].as_py() == 0:
            same = rec["s"][1:] == rec["s"][:-1]
            rec = rec[np.r_[False, same] | np.r_[same, False]]
            s, at = np.unique(np.concatenate([rec["s"], past["s"]]), return_inverse=True)
            places = np.bincount(at, weights=np.concatenate([np.ones(len(rec)), past["k"]])).astype(np.int64)
            many = (block << 32) + s[places > hot].astype(np.int64), places[places > hot]
        rec = rec[np.argsort(rec["k"], kind="stable")]
        first = np.flatnonzero(np.r_[True, rec["k"][1:] != rec["k"][:-1]]) if len(rec) else np.zeros(0, int)
        n, m = len(first), len(many[0])
        return pa.table({
            "block": pa.array(np.full(n + m, block, np.int32)), "key": pa.array(rec["k"][first].tolist() + [None] * m, pa.int64()),
            "anchors": pa.array(([r.tobytes() for r in np.split(rec, first[1:])] if n else []) + [None] * m, pa.binary()),
            "anchor": pa.array([None] * n + many[0].tolist(), pa.int64()), "places": pa.array([None] * n + many[1].tolist(), pa.int64()),
        })

    return posted.groupBy("block", "part").applyInArrow(run, "block int, key long, anchors binary, anchor long, places long")


def _word(rows: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each row as a number that orders like them."""
    return np.ascontiguousarray(rows[:, at : at + 8]).view(">u8").ravel().astype(np.uint64)


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row by these keys (first is most significant), equal rows equal."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sort_block(rows: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """repeat[i, j]: the suffix of row i at column j, of first[i] <= j <= last[i], agrees in `length` bytes with that of
    another row of its group at that column."""
    width = rows.shape[1]
    repeat = np.zeros((len(rows), width - length + 1), bool)
    depth = V
    while 2 * depth + 2 * V <= length:
        depth *= 2
    residues = [c for c in range(width) if c % V in COVER]
    rank = {c: _dense([_word(rows, c + 8 * k) for k in range(V // 8)]) for c in residues if c + V <= width}
    size = V
    while size < depth:
        rank = {c: _dense([r, rank[c + size]]) for c, r in rank.items() if c + size in rank}
        size *= 2
    for j in range(width - length + 1):
        at = np.flatnonzero((first <= j) & (j <= last))
        if len(at) < 2:
            continue
        keys = [group[at], *(_word(rows[at], j + 8 * k) for k in range(V // 8))]
        q = next(c for c in residues if c >= j)
        while q + depth < j + length - V:  # ranks that follow on each other
            keys.append(rank[q][at])
            q = max(c for c in residues if c <= min(q + depth, j + length - depth))
        keys.append(rank[q][at])
        keys += [_word(rows[at], j + length - V + 8 * k) for k in range(V // 8)]
        order = np.lexsort(keys[::-1])
        same = np.ones(len(at) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        repeat[at[order], j] = np.r_[False, same] | np.r_[same, False]
    return repeat


def spans_of_block(t: pa.Table, length: int) -> pa.Table:
    """key, spans (start, end as a blob of int64 pairs): bytes covered by repeated strings, from one block's contexts."""
    keys, blobs, ctx = t.column("key").to_numpy(), t.column("anchors").to_pylist(), t.column("contexts").to_pylist()
    rec = np.concatenate([np.frombuffer(x, _ANCHOR) for x in blobs])
    x0, x1 = rec["x0"].astype(np.int64), rec["x1"].astype(np.int64)
    size = length + x0 - x1
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    before = length - GRAM
    width = -(-(before + length) // V) * V
    rows = np.zeros((len(rec), width), np.uint8)
    # Context i begins at column before - x0, so that every anchor is in column `before`.
    rows.ravel()[K.ragged(np.arange(len(rec)) * width + before - x0, size)] = flat
    head = np.stack([rec["s"].astype(np.int64), x0, x1], 1)
    whole = np.ascontiguousarray(np.concatenate([head.astype("<u4").view(np.uint8).reshape(len(rec), -1), rows], 1))
    _, one, back, count = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(rec["s"][one], kind="stable")
    s = rec["s"][one][order]
    alone = np.r_[True, s[1:] != s[:-1]] & np.r_[s[1:] != s[:-1], True]
    some = np.sort(order[~alone])
    flags = np.zeros((len(one), before + 1), bool)
    if len(some):
        i = one[some]
        flags[some] = sort_block(rows[i], rec["s"][i], before - x0[i], before - x1[i], length)[:, : before + 1]
    cols = np.arange(before + 1)[None, :]
    flags |= (count > 1)[:, None] & (cols >= (before - x0[one])[:, None]) & (cols <= (before - x1[one])[:, None])
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    # Runs of each distinct context, for all places that have it.
    runs = np.searchsorted(r, np.arange(len(one) + 1))
    n = np.diff(runs)[back.ravel()]
    at = K.ragged(runs[:-1][back.ravel()], n)
    origin = np.repeat(rec["p"].astype(np.int64) - before, n)
    out = np.stack([origin + a[at], origin + b[at] - 1 + length], 1)
    key = np.repeat(np.repeat(keys, [len(x) // _ANCHOR.itemsize for x in blobs]), n)
    order = np.lexsort((out[:, 0], key))
    key, out = key[order], out[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return pa.table({"key": pa.array(key[first]), "spans": pa.array([x.tobytes() for x in np.split(out, first[1:])] if len(first) else [], pa.binary())})


_PIECE = "sub long, q1 long, q2 long, band int, low int, high int, bytes binary, places binary"
_CUT = f"block int, key long, anchors binary, contexts binary, {_PIECE}"


def pieces(s: K.Slice, c: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, key: np.ndarray, rec: np.ndarray, at: np.ndarray, length: int) -> list[pa.Array]:
    """The different pieces (columns as in _PIECE) of hot anchors' contexts in a slice, anchors being at `at` in its data:
    bands of BAND starts, named by how many bytes before the anchor a string starts."""
    x0, x1 = rec["x0"].astype(np.int64), rec["x1"].astype(np.int64)
    n = x0 // BAND - x1 // BAND + 1
    i = np.repeat(np.arange(len(rec)), n)
    band = K.ragged(x1 // BAND, n)
    low, high = np.maximum(x1[i], band * BAND), np.minimum(x0[i], band * BAND + BAND - 1)
    a, b = at[i] - high, at[i] - low + length
    name = K.mix(anchor[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band.astype(np.uint64))
    sub = K.mix(name ^ K.span_hash(c[0], at[i] - band * BAND, at[i] + length - (band * BAND + BAND - 1)))
    ends = K.mix(name + (low * 256 + high).astype(np.uint64))
    q1, q2 = K.mix(ends ^ K.span_hash(c[0], a, b)), K.mix(ends + K.span_hash(c[1], a, b))
    order = np.lexsort((q2, q1))
    first = np.flatnonzero(np.r_[True, (q1[order][1:] != q1[order][:-1]) | (q2[order][1:] != q2[order][:-1])])
    one = order[first]
    places = np.empty(len(i), _PLACE)
    places["k"], places["p"] = key[i], rec["p"][i]
    num = lambda x, t: pa.array(x[one].astype(t))
    return [
        num(sub.view(np.int64), np.int64), num(q1.view(np.int64), np.int64), num(q2.view(np.int64), np.int64), num(band, np.int32), num(low, np.int32), num(high, np.int32),
        pa.array([s.data[x:y].tobytes() for x, y in zip(a[one].tolist(), b[one].tolist())], pa.binary()), pa.array([x.tobytes() for x in np.split(places[order], first[1:])], pa.binary()),
    ]


def marks_of_pieces(t: pa.Table, length: int) -> pa.Table:
    """q1, q2, mask (bit x: the string that starts band * BAND + x bytes before the anchor is repeated) of a block's pieces."""
    sub, q1, q2, band, low, high, several = (t.column(c).to_numpy() for c in ("sub", "q1", "q2", "band", "low", "high", "several"))
    first, last = BAND - 1 - (high - band * BAND), BAND - 1 - (low - band * BAND)
    blobs = t.column("bytes").to_pylist()
    width = -(-(BAND + length) // V) * V
    rows = np.zeros((len(sub), width), np.uint8)
    rows.ravel()[K.ragged(np.arange(len(sub)) * width + first, np.array([len(x) for x in blobs]))] = np.frombuffer(b"".join(blobs), np.uint8)
    cols = np.arange(BAND)[None, :]
    flags = several[:, None] & (cols >= first[:, None]) & (cols <= last[:, None])
    _, group, count = np.unique(sub, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[group] > 1)
    if len(some):
        flags[some] |= sort_block(rows[some], group[some], first[some], last[some], length)[:, :BAND]
    mask = (flags[:, ::-1] * (1 << np.arange(BAND, dtype=np.int64))[None, :]).sum(1)
    return pa.table({"q1": pa.array(q1), "q2": pa.array(q2), "mask": pa.array(mask)})


def marks(met: DataFrame, length: int, hot: int) -> DataFrame:
    """q1, q2, mask of all different pieces."""
    met = materialize(met.withColumn("several", F.col("n") > 1), "pieces")
    sizes = met.groupBy("sub").agg(F.count("*").alias("c"))
    large = materialize(sizes.where(F.col("c") > hot).select("sub"), "large")
    blocks = 1 + met.count() // BLOCK_PIECES
    usual = met.join(small(large), "sub", "left_anti").withColumn("block", F.pmod("sub", F.lit(blocks)))
    found = usual.groupBy("block").applyInArrow(lambda t: marks_of_pieces(t, length), "q1 long, q2 long, mask long")
    if large.isEmpty():
        return found

    def single(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "bytes"):
            c = digest_sum(s.data)
            sub, q1, q2, band, low, high, n = (s.rows.column(k).to_numpy() for k in range(7))
            i = np.repeat(np.arange(len(sub)), high - low + 1)
            a = s.off[:-1][i] + K.ragged(np.zeros(len(sub), np.int64), (high - low + 1).astype(np.int64))
            x = high[i] - (a - s.off[:-1][i])
            name = K.mix(sub[i].view(np.uint64) + x.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((name ^ K.span_hash(c[0], a, a + length)).view(np.int64)), pa.array((name + K.span_hash(c[1], a, a + length)).view(np.int64)), pa.array(q1[i]), pa.array(q2[i]), pa.array(np.int64(1) << (x - band[i] * BAND).astype(np.int64)), pa.array(n[i])], ["h1", "h2", "q1", "q2", "bit", "n"])

    strings = met.join(small(large), "sub", "left_semi").select("sub", "q1", "q2", "band", "low", "high", "n", "bytes").mapInArrow(single, "h1 long, h2 long, q1 long, q2 long, bit long, n long")
    strings = materialize(strings, "strings")
    again = strings.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("h1", "h2")
    return found.unionByName(strings.join(again, ["h1", "h2"]).groupBy("q1", "q2").agg(F.sum("bit").alias("mask")))


def spans_of_pieces(cut: DataFrame, length: int, hot: int) -> DataFrame:
    """key, spans: bytes covered by repeated strings that hot anchors stand for."""
    met = cut.where("q1 is not null")
    of = F.octet_length("places") / _PLACE.itemsize
    ends = marks(met.groupBy("q1", "q2").agg(*[F.first(c).alias(c) for c in ("sub", "band", "low", "high", "bytes")], F.sum(of.cast("long")).alias("n")), length, hot)
    ends = materialize(ends.where("mask <> 0"), "marks")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            out, keys = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for band, mask, blob in zip(*(t.column(c).to_pylist() for c in ("band", "mask", "places"))):
                at = np.frombuffer(blob, _PLACE)
                edge = np.diff(np.r_[0, (mask >> np.arange(BAND)) & 1, 0])
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                    out.append(np.stack([at["p"] - (band * BAND + y - 1), at["p"] - (band * BAND + x) + length], 1))
                    keys.append(at["k"])
            key, span = np.concatenate(keys), np.concatenate(out)
            order = np.lexsort((span[:, 0], key))
            key, span = key[order], span[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array([joined(x).tobytes() for x in np.split(span, first[1:])] if len(first) else [], pa.binary())], ["key", "spans"])

    return met.select("q1", "q2", "band", "places").join(ends, ["q1", "q2"]).select("band", "mask", "places").mapInArrow(run, "key long, spans binary")


def joined(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans; overlapping or touching ones are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > top[:-1]])
    return np.stack([spans[new, 0], top[np.r_[new[1:], len(spans)] - 1]], 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end in bytes): one row per row of docs.

    Removed is each byte covered by a string of `length` bytes that starts at another place too, in any text or the same
    one, judged on the input. A text that occurs in several rows is removed whole (if long enough) and stands once for
    itself in all comparisons. Null texts are empty; texts under `length` bytes keep all. Ids may be null or repeated.
    No rows give no rows; extra columns are ignored. Anchors travel as 18 bytes each (about one in 85 bytes of text),
    contexts of repeated anchors only as the bytes their strings span. Blocks hold at most `hot` places of one anchor.
    """
    if not 2 * V < length <= 255 + GRAM:
        raise ValueError("length")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    meta = materialize(t.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "meta")
    copies = materialize(meta.groupBy("sha").agg(F.count("*").alias("c"), F.min("doc_id").alias("rep"), F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes")), "copies")
    blocks = 1 + int(copies.agg(F.sum("n_bytes")).first()[0] or 0) // block_bytes
    long_texts = t.where(F.octet_length("text") >= length)
    met = materialize(repeated_anchors(post(long_texts.select("key", "text"), blocks, length), hot), "anchors")
    many = numbers(met.where("anchor is not null").orderBy(F.desc("places"), "anchor").limit(HOT_ANCHORS).select("anchor")).view(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(many))
    wanted = met.where("key is not null").groupBy("key").agg(F.collect_list(F.struct("block", "anchors")).alias("parts"))
    wanted = wanted.join(copies.select("key", F.col("rep").alias("doc_id")), "key")
    wanted = materialize(wanted, "wanted")
    texts = long_texts.join(wanted, (long_texts["key"] == wanted["key"]) & long_texts["doc_id"].eqNullSafe(wanted["doc_id"])).select(wanted["key"], "parts", "text")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, names = shared.value, [x.split()[0] for x in _CUT.split(", ")]
        for s in K.text_slices(it, "text"):
            out: list[list] = [[], [], [], []]
            later: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _ANCHOR)], [np.zeros(0, np.int64)]]
            for i, (key, parts) in enumerate(zip(s.rows.column(0).to_pylist(), s.rows.column(1).to_pylist())):
                base, end = int(s.off[i]), int(s.off[i + 1])
                by_block: dict[int, list[np.ndarray]] = {}
                for part in parts:
                    by_block.setdefault(part["block"], []).append(np.frombuffer(part["anchors"], _ANCHOR))
                for block, recs in by_block.items():
                    rec = recs[0] if len(recs) == 1 else np.unique(np.concatenate(recs))
                    a, n = base + rec["p"].astype(np.int64) - rec["x0"], length + rec["x0"].astype(np.int64) - rec["x1"]
                    if int((a + n).max()) > end or int(a.min()) < base:
                        continue  # another text of equal key
                    anchor = (block << 32) + rec["s"].astype(np.int64)
                    late = np.isin(anchor, many) if len(many) else np.zeros(len(rec), bool)
                    if late.any():
                        for x, y in zip(later, (anchor[late], np.full(int(late.sum()), key), rec[late], a[late] + rec["x0"][late])):
                            x.append(y)
                        rec, a, n = rec[~late], a[~late], n[~late]
                    if len(rec):
                        for x, y in zip(out, (block, key, rec.tobytes(), s.data[K.ragged(a, n)].tobytes())):
                            x.append(y)
            first = [pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
            if len(later[0]) > 1:
                anchor, key, rec, at = (np.concatenate(x) for x in later)
                more = pieces(s, digest_sum(s.data), anchor, key, rec, at, length)
                first = [pa.concat_arrays([x, pa.nulls(len(more[0]), x.type)]) for x in first]
                more = [pa.concat_arrays([pa.nulls(len(out[0]), x.type), x]) for x in more]
            else:
                more = [pa.nulls(len(out[0]), x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*first, *more], names)

    contexts = texts.mapInArrow(cut, _CUT)
    if len(many):
        contexts = materialize(contexts, "contexts")
    spans = contexts.where("block is not null").select("block", "key", "anchors", "contexts").groupBy("block").applyInArrow(lambda x: spans_of_block(x, length), "key long, spans binary")
    if len(many):
        spans = spans.unionByName(spans_of_pieces(contexts, length, hot))
    lone = copies.where("c = 1").select("key", F.col("rep").alias("doc_id"))
    spans = materialize(spans.groupBy("key").agg(F.collect_list("spans").alias("spans")).join(lone, "key"), "spans")
    hit = long_texts.join(spans, (long_texts["key"] == spans["key"]) & long_texts["doc_id"].eqNullSafe(spans["doc_id"])).select(spans["key"], long_texts["doc_id"], "spans", "text")

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            found, sha = [], []
            for i, parts in enumerate(s.rows.column(2).to_pylist()):
                text = s.data[s.off[i] : s.off[i + 1]]
                x = joined(np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2))
                gone = np.zeros(len(text) + 1, np.int64)
                gone[x[:, 0]] += 1
                gone[x[:, 1]] -= 1
                found.append([{"start": a, "end": b} for a, b in x.tolist()])
                sha.append(hashlib.sha256(text[np.cumsum(gone[:-1]) == 0].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string())], ["key", "doc_id", "spans", "kept"])

    removed = hit.mapInArrow(keep, "key long, doc_id long, spans array<struct<start:long,end:long>>, kept string")
    removed = materialize(removed.withColumnRenamed("doc_id", "of").withColumnRenamed("key", "k"), "removed")
    several = small(copies.where("c > 1").select("sha", F.lit(True).alias("copied")), 80)
    out = meta.join(several, "sha", "left")
    out = out.join(removed, (out["key"] == removed["k"]) & out["doc_id"].eqNullSafe(removed["of"]) & F.col("copied").isNull(), "left")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.select("doc_id", "n_bytes", F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Windows hashed by steps of 5, 5 and 8 places: 200 bytes.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, unnest(regexp_extract_all(x, '..')) AS v, generate_subscripts(regexp_extract_all(x, '..'), 1) AS i FROM d),
h3 AS (SELECT r, i, v, hash(v, lead(v, 1) OVER w, lead(v, 2) OVER w, lead(v, 3) OVER w, lead(v, 4) OVER w) AS a FROM b WINDOW w AS (PARTITION BY r ORDER BY i)),
h4 AS (SELECT r, i, v, hash(a, lead(a, 5) OVER w, lead(a, 10) OVER w, lead(a, 15) OVER w, lead(a, 20) OVER w) AS a FROM h3 WINDOW w AS (PARTITION BY r ORDER BY i)),
h5 AS (SELECT r, i, v, hash(a, lead(a, 25) OVER w, lead(a, 50) OVER w, lead(a, 75) OVER w, lead(a, 100) OVER w, lead(a, 125) OVER w, lead(a, 150) OVER w, lead(a, 175) OVER w) AS a,
  lead(i, 199) OVER w IS NOT NULL AS whole FROM h4 WINDOW w AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT a FROM h5 WHERE whole GROUP BY a HAVING count(*) > 1),
m AS (SELECT r, i, v, max(CASE WHEN whole AND a IN (SELECT a FROM rep) THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM h5),
e AS (SELECT r, i, v, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS start FROM m),
s AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE start) AS n_spans, string_agg(v, '' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM e GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
