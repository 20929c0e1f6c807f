"""Quality classifier by attention-based multiple-instance learning (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_sample, crc_of, small, table

PASSAGE_WORDS = 64
BAG = 32
HIDDEN, GATE = 32, 16
#: Labelled documents the model is fitted on, chosen by a hash of the id.
TRAIN_DOCS = 3000
STEPS = 200
CUT = 0.3
_LETTER = K.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_CLASSES = [K.byte_class((0x41, 0x5A)), K.byte_class((0x30, 0x39)), K.byte_class((0x80, 0xFF)), ~_LETTER & ~K.byte_class((0x30, 0x39), (0x20, 0x20), (0x09, 0x0D))]
N_FEATURES = 14 + BAG


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (PASSAGE_WORDS words; a text without words is one empty passage), and row offsets."""
    w = K.words(data, off, K.SPACED)
    n = np.diff(w.off)
    per = np.maximum(1, -(-n // PASSAGE_WORDS))
    poff = np.r_[0, np.cumsum(per)]
    first = K.ragged(np.zeros(len(n), np.int64), per) * PASSAGE_WORDS + np.repeat(w.off[:-1], per)
    count = np.minimum(PASSAGE_WORDS, np.repeat(w.off[1:], per) - first)
    x = np.zeros((int(poff[-1]), N_FEATURES), np.float32)
    full = np.flatnonzero(count > 0)
    if not len(full):
        return x, poff
    a, c = first[full], count[full]
    b = a + c

    def mean(v: np.ndarray, by: np.ndarray = c) -> np.ndarray:
        s = np.r_[0, np.cumsum(v, dtype=np.float64)]
        return (s[b] - s[a]) / by

    size = w.end - w.start
    chars = w.end[b - 1] - w.start[a]
    x[full, 0] = np.log1p(c)
    x[full, 1] = mean(size)
    x[full, 2] = np.sqrt(np.maximum(mean(size.astype(float) ** 2) - x[full, 1] ** 2, 0))
    for k, cls in enumerate(_CLASSES):
        s = np.r_[0, np.cumsum(cls[data], dtype=np.int64)]
        x[full, 3 + k] = (s[w.end[b - 1]] - s[w.start[a]]) / chars
    same = np.r_[False, w.h[1:] == w.h[:-1]]
    same[w.off[:-1][n > 0]] = False
    x[full, 7] = mean(same)
    end = data[w.end - 1]
    mark = ~_LETTER[end] & ~K.byte_class((0x30, 0x39))[end]
    stop = (end == 0x2E) | (end == 0x2C)
    x[full, 8], x[full, 9] = mean(mark & ~stop), mean(stop)
    x[full, 10] = mean(~_LETTER[end] & (size == 1))
    passage = np.repeat(np.arange(len(full)), c)
    word = w.h[K.ragged(a, c)]
    order = np.lexsort((word, passage))
    new = np.r_[True, (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    x[full, 11] = np.bincount(passage[order][new], minlength=len(full)) / c
    x[full, 12] = np.log1p(np.repeat(n, per)[full])
    x[full, 13] = chars / c
    sign = np.where(word >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(passage * BAG + (word % np.uint64(BAG)).astype(np.int64), sign, len(full) * BAG)
    x[full, 14:] = bag.reshape(-1, BAG) / np.sqrt(c)[:, None]
    return x, poff


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """h = tanh(W x + b); weight = softmax over a text's passages of w (tanh(V h) * sigmoid(U h)); p = sigmoid(c . sum(weight h) + d)."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, bias: float):
        r = np.random.default_rng(11)
        self.mean, self.std = mean, std
        self.p = {
            "W": r.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.2, (HIDDEN, GATE)),
            "U": r.normal(0, 0.2, (HIDDEN, GATE)), "w": r.normal(0, 0.2, GATE), "c": np.zeros(HIDDEN), "d": np.array(bias),
        }

    def forward(self, x: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        p, first, doc = self.p, off[:-1], K.segments_of(off)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, first)[doc])
        weight = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"]), "doc": doc}

    def gradient(self, x: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, off)
        dz0 = (f["score"] - y) / len(y)
        dz = dz0[:, None] * p["c"]
        doc, weight, h, v, u = (f[k] for k in ("doc", "weight", "h", "v", "u"))
        dh = weight[:, None] * dz[doc]
        dw = (h * dz[doc]).sum(1)
        ds = weight * (dw - np.add.reduceat(weight * dw, off[:-1])[doc])
        g = ds[:, None] * p["w"]
        dv, du = g * u * (1 - v * v), g * v * u * (1 - u)
        dh += dv @ p["V"].T + du @ p["U"].T
        da = dh * (1 - h * h)
        return {"W": x.T @ da, "b": da.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ dz0, "d": dz0.sum()}

    def score(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.std, off)["score"]


def fit(x: np.ndarray, off: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
    """Adam on the log loss of the texts' labels."""
    rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    model = Model(x.mean(0) if len(x) else np.zeros(N_FEATURES), x.std(0) + 1e-3 if len(x) else np.ones(N_FEATURES), float(np.log(rate / (1 - rate))))
    if not len(y):
        return model
    x = (x - model.mean) / model.std
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for t in range(1, steps + 1):
        for k, g in model.gradient(x, off, y).items():
            g = g + 1e-4 * model.p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            model.p[k] = model.p[k] - 0.02 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
    return model


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """Fits on about `rows` labelled texts whose crc32 of the id is no multiple of 5. Their passages' features are
    computed where the texts are and only these numbers are collected."""
    mine = labels.where((crc_of("doc_id") % 5 != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    mine = bounded_sample(mine, "doc_id", rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            x, off = passages(s.data, s.off)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array([x[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["quality", "x"])

    got = documents.select("doc_id", "text").join(small(mine), "doc_id").select("quality", "text").mapInArrow(run, "quality int, x binary").collect()
    got = sorted((r["quality"], bytes(r["x"])) for r in got)
    parts = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in got]
    off = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    model = fit(np.concatenate([np.zeros((0, N_FEATURES), np.float32), *parts]).astype(np.float64), off, np.array([q for q, _ in got], float))
    K.let_go()
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages: one row per row of docs, with no shuffle.

    Every passage of a whole text is encoded; the learned attention weighs them and the weighted sum is scored. A null
    or empty text is one empty passage and gets that passage's score; with no labelled rows every score is 0.5. Repeated
    rows get equal results; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in K.text_slices(it, "text"):
            x, off = passages(s.data, s.off)
            score = shared.value.score(x, off)
            yield pa.RecordBatch.from_arrays([s.rows.column(0).cast(pa.int64()), s.rows.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(np.diff(off))], ["doc_id", "held_out", "score", "predicted", "n_passages"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of("doc_id") % 5 == 0).alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
