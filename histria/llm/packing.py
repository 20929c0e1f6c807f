"""Sequence packing as a cutting-stock problem, solved by column generation (operator 3)."""

from __future__ import annotations

import json
import logging
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, small, table

TOKENS = 4096
END_ID = 2
#: Lengths are put into classes of this many tokens, so the linear program has TOKENS / UNIT rows at any corpus size.
UNIT = 8
#: Distinct strings kept with their ids by a worker (about 30 bytes each); beyond that the store starts anew.
CACHE_STRINGS = 1_000_000
#: Text bytes encoded at once. Working arrays take about 40 bytes for each.
ENCODED_BYTES = 1 << 18
_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
TOKENIZER = "word_bpe_49k.json"
#: How the tokenizer has to normalize and split texts for strings to be encoded one by one (fixed values of its file).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
log = logging.getLogger(__name__)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts. White space never is part of a token here, so each white-space-free string is encoded once.

    Strings are known by 64-bit hashes with A-Z lowered (the tokenizer lowers letters itself); those with a special
    token's bracket, which is matched before lowering, by hashes of their very bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads keep memory of their own
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        normal, split = (made.get("normalizer") or {}).get("normalizers", []), (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in normal] != NORMALIZERS or not split or split[0].get("pattern") != {"Regex": SPLIT} or made["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path}: a tokenizer that splits texts in another way")
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def strings(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash): runs without ASCII white space, up to eight marks at the end parted from a letter or digit
        before them, as the tokenizer parts them anyway."""
        start, end = K.runs(data, off, K.SPACED)
        cut = end.copy()
        for _ in range(8):
            cut -= (cut > start) & _MARKS[data[np.maximum(cut - 1, 0)]]
        ok = (cut > start) & (cut < end)
        ok[ok] = _ALNUM[data[cut[ok] - 1]]
        start, end = np.sort(np.concatenate([start, cut[ok]])), np.sort(np.concatenate([end, cut[ok]]))
        h = K.span_hash(K.byte_prefix(data, True), start, end)
        opens = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else np.zeros(0, np.int64)
        if len(opens):
            own = np.unique(np.searchsorted(start, opens, "right") - 1)
            h[own] = ~K.span_hash(K.byte_prefix(data, False), start[own], end[own])
            self.special = set(h[own].tolist())
        else:
            self.special = set()
        return start, end, h

    def _encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each). Strings of lower-case letters are one token word each, so they are encoded as
        one text and cut where token words end; the others one by one."""
        plain = [s.isalpha() and s.islower() for s in new]
        words, others = [s for s, x in zip(new, plain) if x], [s for s, x in zip(new, plain) if not x]
        flat = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1 if len(flat) else np.zeros(0, np.int64)
        if len(ends) != len(words):
            others, words, flat, ends = new, [], flat[:0], ends[:0]
            plain = [False] * len(new)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        rest = np.fromiter((i for x in got for i in x), np.uint32, sum(map(len, got)))
        plain = np.array(plain, bool)
        n, start = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        n[plain], n[~plain] = np.diff(np.r_[0, ends]), [len(x) for x in got]
        start[plain] = ends - n[plain]
        start[~plain] = len(flat) + np.cumsum(n[~plain]) - n[~plain]
        return np.concatenate([flat, rest])[K.ragged(start, n)], n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): those of text i are ids[offsets[i]:offsets[i + 1]]."""
        start, end, h = self.strings(data, off)
        values, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(values) > max(CACHE_STRINGS, len(values)):
            self.clear()
        at = np.searchsorted(self.known, values)
        new = np.ones(len(values), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != values
        if new.any():
            raw = data.tobytes()
            texts = [(raw[a:b] if x in self.special else raw[a:b].lower()).decode() for a, b, x in zip(start[first[new]].tolist(), end[first[new]].tolist(), values[new].tolist())]
            ids, n = self._encode_new(texts)
            place = at[new]
            self.known = np.insert(self.known, place, values[new])
            self.start = np.insert(self.start, place, (len(self.ids) + np.cumsum(n) - n).astype(np.uint32))
            self.length = np.insert(self.length, place, n.astype(np.uint32))
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, values)
        at = at[back]
        length = self.length[at].astype(np.int64)
        ends = np.r_[0, np.cumsum(length)]
        return self.ids[K.ragged(self.start[at].astype(np.int64), length)], ends[np.searchsorted(start, off)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    K.held["encoder"] = _encoders.clear
    return _encoders[path]


_CUT = "doc_id long, doc_tokens long, crcs array<long>, cls int, rank long, full_rank long, chunk long"


def cut_documents(docs: DataFrame, path: str, capacity: int, unit: int) -> DataFrame:
    """Per document: token count, checksum of each piece (full ones of `capacity`, then the rest), class of the rest, and
    running numbers inside its chunk (the partition it is in) of its class and of its full pieces."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, fulls, ranks = TaskContext.get().partitionId(), 0, np.zeros(capacity // unit + 2, np.int64)
        for s in K.text_slices(it, "text", ENCODED_BYTES, keep="encoder"):
            ids, off = encoder(path).encode(s.data, s.off)
            crcs, cls, rank, full = [], [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                raw = ids[a:b].tobytes() + END_ID.to_bytes(4, "little")
                crcs.append([zlib.crc32(raw[i : i + 4 * capacity]) for i in range(0, len(raw), 4 * capacity)])
                rest = (b - a + 1) % capacity
                c = -(-rest // unit)
                cls.append(c)
                rank.append(ranks[c])
                full.append(fulls)
                ranks[c] += 1
                fulls += (b - a + 1) // capacity
            yield pa.RecordBatch.from_arrays(
                [s.rows.column(0).cast(pa.int64()), pa.array(np.diff(off) + 1), pa.array(crcs, pa.list_(pa.int64())), pa.array(cls, pa.int32()), pa.array(rank, pa.int64()), pa.array(full, pa.int64()), pa.array([chunk] * len(cls), pa.int64())],
                ["doc_id", "doc_tokens", "crcs", "cls", "rank", "full_rank", "chunk"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CUT)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best pattern under these dual prices."""
    worth, place = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth[sizes], place[sizes] = values, np.arange(len(sizes))
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[:c][::-1] + worth[1 : c + 1]  # of taking a size 1..c last; sizes that are not there are worth nothing
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c]:
            pattern[place[took[c]]] += 1
        c -= max(1, int(took[c]))
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = 4000) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns (items of each size) and how often each is used, which together hold exactly the demand; and a number
    of uses that no packing stays below.

    A revised simplex over patterns: the knapsack prices columns by the dual values until none improves (or max_columns
    were added, which costs fill, never items: the bound tells how much). The optimum is rounded down; what it leaves (fewer items than
    sizes x capacity, whatever the demand) is packed first-fit decreasing.
    """
    m = len(sizes)
    if not m:
        return [], 0.0
    bound = 0.0
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(max_columns):
        duals = inverse.sum(0)
        value, new = price(duals, sizes, capacity)
        bound = max(bound, float(duals @ demand) / max(value, 1.0))  # duals / value are feasible
        if value <= 1 + 1e-7:
            break
        d = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        columns[:, r] = new
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    used = np.floor(x + 1e-9).astype(np.int64)
    left = demand.astype(np.int64) - columns.astype(np.int64) @ used
    while (left < 0).any():  # rounding noise: take back one use of a pattern with too many items
        k = int(np.flatnonzero(left < 0)[0])
        p = int(np.flatnonzero((columns[k] > 0) & (used > 0))[0])
        used[p] -= 1
        left += columns[:, p].astype(np.int64)
    out = [(columns[:, p].astype(np.int64), int(used[p])) for p in range(m) if used[p]]
    bins: list[np.ndarray] = []
    free = np.zeros(0, np.int64)
    for k in range(m - 1, -1, -1):
        for _ in range(left[k]):
            fit = np.flatnonzero(free >= sizes[k])
            if len(fit):
                b = int(fit[free[fit].argmin()])
            else:
                b, free = len(bins), np.r_[free, capacity]
                bins.append(np.zeros(m, np.int64))
            bins[b][k] += 1
            free[b] -= sizes[k]
    return out + [(b, 1) for b in bins], bound


class Plan:
    """Where the k-th document of a class goes: its sequence and its place there. Its size depends on classes alone."""

    def __init__(self, sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]):
        uses = np.array([n for _, n in patterns], np.int64)
        base = np.cumsum(uses) - uses
        self.sequences, self.by_class = int(uses.sum()), {}
        before = np.zeros(len(patterns), np.int64)
        for k, size in enumerate(sizes.tolist()):
            per = np.array([p[k] for p, _ in patterns], np.int64)
            has = np.flatnonzero(per)
            self.by_class[size] = (np.r_[0, np.cumsum(per[has] * uses[has])], per[has], base[has], before[has])
            before += per

    def place(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for c in np.unique(cls).tolist():
            at = np.flatnonzero(cls == c)
            ends, per, base, before = self.by_class[c]
            p = np.searchsorted(ends, rank[at], "right") - 1
            k = rank[at] - ends[p]
            seq[at], slot[at] = base[p] + k // per[p], before[p] + k % per[p]
        return seq, slot


def pack(docs: DataFrame, path: str | None = None, capacity: int = TOKENS, unit: int = UNIT) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (and the end id) are cut into full pieces of `capacity`, each a sequence, and a rest. The rests'
    lengths, rounded up to classes of `unit` tokens, are the stock to cut: column generation on their histogram (at most
    capacity / unit rows on the driver) gives patterns, and the documents of a class, numbered by two-level ranks (inside
    the task that wrote them, after the totals of the tasks before), fill the patterns' places in order. A class may
    hold any share of all rows: no task gathers a class. Offsets inside a sequence sum at most `capacity` tokens.

    A null or empty text is the end id alone; repeated rows are packed as often as they occur; no rows give no rows;
    extra columns are ignored. Numbers are those of the input's partitions, so the same files give the same sequences.
    """
    cut = materialize(cut_documents(docs, path or tokenizer_path(), capacity, unit), "cut")
    counts = materialize(cut.groupBy("chunk", "cls").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {capacity}")).alias("fulls")), "counts")
    histogram = {r["cls"]: r["n"] for r in counts.where("cls > 0").groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most capacity / unit rows
    sizes = np.array(sorted(histogram), np.int64)
    patterns, least = cutting_stock(sizes, np.array([histogram[c] for c in sizes.tolist()], float), capacity // unit)
    plan = Plan(sizes, patterns)
    log.info("rests fill %d sequences, at least %.1f are needed", plan.sequences, least)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("cls").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))  # one row a task and class
    chunks = counts.groupBy("chunk").agg(F.sum("fulls").alias("fulls"))  # one row a task
    chunks = chunks.select("chunk", F.coalesce(F.sum("fulls").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full0"))
    ranked = cut.join(small(offsets), ["chunk", "cls"]).join(small(chunks), "chunk")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seq, slot = shared.value.place(b.column("cls").to_numpy(), b.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc_tokens"), b.column("crc"), pa.array(seq), pa.array(slot)], ["doc_id", "doc_tokens", "crc", "sequence_id", "slot"])

    rests = ranked.where("cls > 0").select("doc_id", "doc_tokens", "cls", (F.col("rank0") + F.col("rank")).alias("at"), F.element_at("crcs", -1).alias("crc"))
    rests = rests.mapInArrow(place, "doc_id long, doc_tokens long, crc long, sequence_id long, slot long").withColumn("length", F.col("doc_tokens") % capacity)
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.select("doc_id", (F.col("doc_tokens") - F.col("length")).alias("start"), "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    full = ranked.where(f"doc_tokens >= {capacity}").select("doc_id", "doc_tokens", "full0", "full_rank", F.posexplode(F.slice("crcs", F.lit(1), F.expr(f"cast(doc_tokens div {capacity} as int)"))).alias("k", "crc"))
    full = full.select("doc_id", (F.col("k") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("full0") + F.col("full_rank") + F.col("k") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rests.unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack() of all rows: every one is kept, null and empty texts as an end id, repeated ones each."""
    return pack(docs)
