"""Language identification of words and documents by a linear-chain conditional random field (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_of, table

LETTERS = K.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BUCKETS = 1 << 16
#: Words of a text labelled together by one chain, and words beyond its ends that it takes in so that these do not show.
CHAIN, MARGIN = 256, 24
#: Labelled documents (per language) the model is fitted on, chosen by a hash of the id.
TRAIN_DOCS = 250
#: ... and bytes of their texts, about, per language.
TRAIN_BYTES = 4 << 20
LEXICON = 2000
STEPS = 40
#: Certainty (mean over the words of the largest posterior) from which the stage keeps a text, whatever mixture it is.
MIN_CERTAINTY = 0.5
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32


def features(data: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word (affixes of 1 to 3 bytes, 2- and 3-grams, the word itself) and offsets."""
    low, n = _LOW[data], w.end - w.start
    kinds, counts = [], []

    def add(tag: int, value: np.ndarray, count: np.ndarray) -> None:
        kinds.append((K.mix(value * np.uint64(16) + np.uint64(tag)) % np.uint64(BUCKETS)).astype(np.int32))
        counts.append(count)

    one = np.ones(len(n), np.int64)
    add(0, w.h, one)
    pre, suf = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for k in range(3):
        pre = pre * np.uint64(256) + np.where(n > k, low[np.minimum(w.start + k, len(data) - 1)], 0).astype(np.uint64)
        suf = suf * np.uint64(256) + np.where(n > k, low[np.maximum(w.end - 1 - k, 0)], 0).astype(np.uint64)
        add(1 + k, pre, one)
        add(4 + k, suf, one)
    for k in (2, 3):
        count = np.maximum(n - k + 1, 0)
        at = K.ragged(w.start, count)
        value = low[at] * np.uint64(256) + low[at + 1]
        add(5 + k, value if k == 2 else value * np.uint64(256) + low[at + 2], count)
    total = sum(counts)
    off = np.r_[0, np.cumsum(total)]
    out = np.zeros(int(off[-1]), np.int32)
    at = off[:-1].copy()
    for f, c in zip(kinds, counts):
        out[K.ragged(at, c)] = f
        at += c
    return out, off


class Model:
    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels, self.theta, self.transitions = labels, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n))
        self.lexicon, self.lexicon_weight = np.zeros(0, np.uint64), np.zeros((0, n), np.float32)

    def emissions(self, data: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each distinct word of the slice, and which of them each word is."""
        _, first, back = np.unique(w.h, return_index=True, return_inverse=True)
        own = K.Words(w.h[first], w.start[first], w.end[first], w.off)
        f, off = features(data, own)
        score = np.add.reduceat(self.theta[f], off[:-1], axis=0)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, own.h), len(self.lexicon) - 1)
            score += np.where((self.lexicon[at] == own.h)[:, None], self.lexicon_weight[at], 0)
        return score, back

    def posteriors(self, scores: np.ndarray, start: np.ndarray, length: np.ndarray, want_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains of words (start, length), all chains in step. With the longest chain first, the
        words of a step lie side by side."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        top = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(1, top + 1), "right")
        off = np.r_[0, np.cumsum(alive)].astype(np.int64)
        at = start[K.ragged(np.zeros(top, np.int64), alive)] + np.repeat(np.arange(top), alive)
        s = scores[at]
        most = s[:, 0].copy()
        for k in range(1, s.shape[1]):
            np.maximum(most, s[:, k], out=most)
        e = np.exp(s - most[:, None]).astype(np.float64) + 1e-30
        t = np.exp(self.transitions - self.transitions.max())
        one = np.ones((e.shape[1], 1))
        alpha, pairs = np.empty_like(e), np.zeros_like(t)
        a = None
        for k in range(top):
            now = e[off[k] : off[k + 1]]
            a = now if a is None else (a[: alive[k]] @ t) * now
            a = a / (a @ one)
            alpha[off[k] : off[k + 1]] = a
        b = np.ones((alive[-1] if top else 0, e.shape[1]))
        for k in range(top - 1, 0, -1):
            n = alive[k]
            if n > len(b):
                b = np.concatenate([b, np.ones((n - len(b), e.shape[1]))])
            eb = e[off[k] : off[k + 1]] * b
            before = alpha[off[k - 1] : off[k - 1] + n]
            if want_pairs:
                pairs += (before.T @ (eb / (((before @ t) * eb) @ one))) * t
            b = eb @ t.T
            b /= b @ one
            # alpha is needed below only at earlier places, so the posterior takes its room
            before *= b
            before /= before @ one
        out = np.zeros((len(scores), e.shape[1]))
        out[at] = alpha
        return out, pairs


def fit(texts: list[tuple[str, str]], steps: int = STEPS, lexicon: int = LEXICON) -> Model:
    """Maximum likelihood with all words of a text labelled by its language; chains join pieces of different texts, so
    the transitions see changes of language."""
    labels = sorted({lang for _, lang in texts})
    model = Model(labels)
    if not labels:
        return model
    arr = pa.record_batch([pa.array([t for t, _ in texts], pa.large_string())], ["t"])
    (s,) = K.text_slices(iter([arr]), "t", 1 << 40)
    w = K.words(s.data, s.off, LETTERS)
    gold = np.repeat(np.array([labels.index(x) for _, x in texts]), np.diff(w.off))
    # Pieces of up to 32 words, dealt at random to chains of 4.
    off = np.unique(np.concatenate([np.arange(a, b, 32) for a, b in zip(w.off[:-1], w.off[1:])] + [np.array([len(w.h)])])) if len(w.h) else np.zeros(1, int)
    rng = np.random.default_rng(7)
    piece = rng.permutation(len(off) - 1)
    length = np.diff(off)[piece]
    word = K.ragged(off[:-1][piece], length)
    ends = np.cumsum(length)
    firsts = np.arange(0, len(piece), 4)
    chain0 = (ends - length)[firsts] if len(piece) else np.zeros(0, int)
    chain_n = np.diff(np.r_[chain0, len(word)])
    values, first, back = np.unique(w.h, return_index=True, return_inverse=True)
    counts = np.zeros((len(values), len(labels)))
    np.add.at(counts, (back, gold), 1)
    share = counts / np.maximum(counts.sum(0, keepdims=True), 1)
    keep = np.unique(np.concatenate([np.argsort(-share[:, k], kind="stable")[:lexicon] for k in range(len(labels))])) if len(values) else np.zeros(0, int)
    keep = keep[counts[keep].sum(1) >= 3]
    model.lexicon = values[keep]
    model.lexicon_weight = np.zeros((len(keep), len(labels)), np.float32)
    f, foff = features(s.data, K.Words(values, w.start[first], w.end[first], w.off))
    in_lexicon = np.full(len(values), -1)
    in_lexicon[keep] = np.arange(len(keep))
    lex = in_lexicon >= 0
    back, gold = back[word], gold[word]
    pair_gold = np.zeros_like(model.transitions)
    inner = np.ones(len(word), bool)
    inner[chain0] = False
    np.add.at(pair_gold, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    counts = np.zeros((len(values), len(labels)))
    np.add.at(counts, (back, gold), 1)
    rows = np.repeat(np.arange(len(values)), np.diff(foff))
    params = [model.theta, model.transitions, model.lexicon_weight]
    m1, m2 = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    total = max(1, len(word))
    for step in range(1, steps + 1):
        if not len(word):
            break
        scores = np.add.reduceat(model.theta[f], foff[:-1], axis=0)
        scores[lex] += model.lexicon_weight[in_lexicon[lex]]
        post, pairs = model.posteriors(scores[back].astype(np.float64), chain0, chain_n, True)
        expected = np.stack([np.bincount(back, post[:, k], len(values)) for k in range(len(labels))], 1)
        g_word = (counts - expected) / total
        g_theta = np.stack([np.bincount(f, g_word[rows, k], BUCKETS) for k in range(len(labels))], 1)
        grads = [g_theta - 1e-7 * model.theta, (pair_gold - pairs) / total - 1e-5 * model.transitions, g_word[keep] - 1e-7 * model.lexicon_weight]
        for p, g, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += (0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)).astype(p.dtype)
    return model


_OUT = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, shares array<double>, certainty double"


def predict(model: Model, s: K.Slice) -> pa.RecordBatch:
    ids, held, texts = s.rows.column(0), s.rows.column(1), s.rows.column(2)
    n, labels = len(ids), len(model.labels)
    w = K.words(s.data, s.off, LETTERS)
    sums, sure = np.zeros((n, labels)), np.zeros(n)
    count = np.diff(w.off)
    if len(w.h) and labels:
        score, back = model.emissions(s.data, w)
        chains = -(-count // CHAIN)
        start = K.ragged(np.zeros(n, np.int64), chains) * CHAIN + np.repeat(w.off[:-1], chains)
        length = np.minimum(CHAIN, np.repeat(w.off[1:], chains) - start)
        a = np.maximum(start - MARGIN, np.repeat(w.off[:-1], chains))
        wide = np.minimum(start + length + MARGIN, np.repeat(w.off[1:], chains)) - a
        begin = np.cumsum(wide) - wide
        post, _ = model.posteriors(score[back[K.ragged(a, wide)]], begin, wide)
        post = post[K.ragged(begin + start - a, length)]
        c = np.concatenate([np.zeros((1, labels)), np.cumsum(post, axis=0)])
        sums = c[w.off[1:]] - c[w.off[:-1]]
        c = np.r_[0, np.cumsum(post.max(1))]
        sure = c[w.off[1:]] - c[w.off[:-1]]
    share = np.clip(sums / np.maximum(count, 1)[:, None], 0, 1)
    has = np.asarray(pc.match_substring_regex(texts, r"\pL").fill_null(False)) & (count > 0) & (labels > 0)
    best = share.argmax(1) if labels else np.zeros(n, int)
    names = np.array([*model.labels, "und"], object)
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), held, pa.array(names[np.where(has, best, -1)], pa.string()), pa.array(np.where(has, share.max(1, initial=0), 0.0)), pa.array(count), pa.array(share.tolist(), pa.list_(pa.float64())), pa.array(np.where(has, np.clip(sure / np.maximum(count, 1), 0, 1), 0.0))],
        ["doc_id", "held_out", "lang_pred", "score", "n_words", "shares", "certainty"],
    )


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """labelled: doc_id, text, lang. At most about per_language texts, or train_bytes of texts, of each language are
    collected, chosen by a hash of the id: one scan counts, one collects."""
    mine = labelled.where("lang is not null and text is not null")
    sizes = mine.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    counts = {r["lang"]: max(r["n"], per_language * r["bytes"] / train_bytes) for r in sizes}
    if not counts:
        return fit([])
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int(min(1.0, per_language / n) * 1e9)))])
    rows = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < F.try_element_at(share, F.col("lang")))
    model = fit(sorted((r["text"], r["lang"]) for r in rows.select("text", "lang").collect()))
    K.let_go()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, shares: one row per row of docs, with no shuffle.

    A word is a run of ASCII letters and bytes of other characters. Each gets a posterior over the languages from
    forward-backward over its chain; `shares` is their mean over the whole text (ordered as model.labels), lang_pred the
    largest share's language and score that share; certainty is the mean of each word's largest posterior. `und` with score 0: text null, empty or without a letter, or no
    labelled rows to learn from. Repeated rows get equal results; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            yield predict(shared.value, s)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of("doc_id") % 3 == 1).alias("held_out"), "text").mapInArrow(run, _OUT)


def trained_on(documents: DataFrame) -> Model:
    return train(documents.where(crc_of("doc_id") % 3 != 1).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained_on(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_words")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """Documents whose words are clearly of known languages, one or several: rows with the columns of docs.

    Null or empty texts, texts without a letter, and texts with a certainty below min_certainty go; without labelled rows
    all do. Each row is judged by its text alone, so repeated rows, repeated or null ids and ties change nothing. No rows
    give no rows; extra columns are kept.
    """
    shared = spark.sparkContext.broadcast(trained_on(docs))
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            n = s.rows.num_rows
            probe = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, bool)), s.rows.column("text")], ["doc_id", "held_out", "text"])
            got = predict(shared.value, K.Slice(probe, s.data, s.off))
            keep = np.array([x != "und" for x in got.column("lang_pred").to_pylist()], bool) & (got.column("certainty").to_numpy() >= min_certainty)
            yield s.rows.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
