"""Quality classifier: a factorisation machine over hashed words and text structure.

Features of a text: hashed words (share of the text's words in each of
BUCKETS buckets) and structure statistics (shares of character classes, word
lengths, variety of words, lines and size), standardised on the sample. The
score is the logistic function of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j;
the pairwise sum is taken in linear time as half of
sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2. Weights are fitted by
stochastic gradient descent with AdaGrad in numpy on a bounded sample,
PER_LABEL texts of each label, weighted back to the labels' shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, labelled
from .words import ALNUM, BLANKS, Slice, find_words, slices, words

PER_LABEL = 1500
BUCKETS, FACTORS = 1 << 13, 4
EPOCHS, RATE, BATCH, DECAY = 8, 0.1, 64, 1e-4
_WORD_SCALE = 4.0
# Character classes of bytes: lower, upper, digit, blank, line end, sentence marks, other marks, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
N_STATS = 16


def features(s: Slice):
    """Of a slice's rows: (row, bucket, share) of words, sorted by row, and the structure statistics."""
    n = s.hi - s.lo
    w = words(s, ALNUM)
    counts = np.diff(w.bounds)
    row = np.repeat(np.arange(n), counts)
    code, seen = np.unique(row * BUCKETS + (w.hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), return_counts=True)
    at, bucket = code // BUCKETS, code % BUCKETS
    share = seen / np.maximum(counts, 1)[at] * _WORD_SCALE
    size = np.diff(s.offs)
    own = np.repeat(np.arange(n), size)
    kind = np.bincount(own * 8 + _CLASS[s.data], minlength=n * 8).reshape(n, 8)
    stat = np.zeros((n, N_STATS))
    stat[:, :8] = kind / np.maximum(size, 1)[:, None]
    length = (w.ends - w.starts).astype(np.float64)
    total = np.maximum(counts, 1)
    stat[:, 8] = np.bincount(row, length, minlength=n) / total
    stat[:, 9] = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=n) / total - stat[:, 8] ** 2, 0))
    stat[:, 10] = np.bincount(at, minlength=n) / total
    stat[:, 11] = np.bincount(at, (seen / total[at]) ** 2, minlength=n)
    stat[:, 12] = np.log1p(size)
    stat[:, 13] = np.log1p(kind[:, 4])
    starts, ends, bounds = find_words(s, BLANKS)
    inner = np.diff(bounds)
    marked = np.isin(_CLASS[s.data[ends - 1]], (6, 2)) if len(ends) else np.zeros(0, bool)
    of = np.repeat(np.arange(n), inner)
    stat[:, 14] = np.bincount(of, marked, minlength=n) / np.maximum(inner, 1)
    stat[:, 15] = np.bincount(of, (_CLASS[s.data[starts]] == 1) if len(starts) else None, minlength=n) / np.maximum(inner, 1)
    return at, bucket, share, stat


class Model:
    """Weights of a factorisation machine; structure statistics are its last N_STATS features."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.spread = w0, w, v, mean, spread

    def scale(self, stat: np.ndarray) -> np.ndarray:
        return np.clip((stat - self.mean) / self.spread, -4, 4) / np.sqrt(N_STATS)

    def logit(self, at, bucket, share, stat) -> np.ndarray:
        n, x = len(stat), self.scale(stat)
        z = self.w0 + np.bincount(at, self.w[bucket] * share, minlength=n) + x @ self.w[BUCKETS:]
        for f in range(self.v.shape[1]):
            v, u = self.v[bucket, f] * share, self.v[BUCKETS:, f]
            z += 0.5 * ((np.bincount(at, v, minlength=n) + x @ u) ** 2 - np.bincount(at, v * v, minlength=n) - (x * x) @ (u * u))
        return z

    def score(self, s: Slice) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*features(s)), -40, 40)))


def train(sample: list[tuple[str, int, float]], seed: int = 3) -> Model:
    """A model of (text, 0 or 1, share of that label) rows; without both labels, a constant."""
    size = BUCKETS + N_STATS
    y_all = {x[1] for x in sample}
    if len(y_all) < 2:
        w0 = 0.0 if not y_all else (4.0 if 1 in y_all else -4.0)
        return Model(w0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    rng = np.random.default_rng(seed)
    y = np.array([x[1] for x in sample], np.float64)
    drawn = {v: float((y == v).mean()) for v in (0, 1)}
    weight = np.array([x[2] / drawn[x[1]] for x in sample])
    rows, stats = [], []
    for s in slices(pa.array([x[0] for x in sample], pa.string())):
        at, bucket, share, stat = features(s)
        cut = np.searchsorted(at, np.arange(s.hi - s.lo + 1))
        rows += [(bucket[a:b], share[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        stats.append(stat)
    stat = np.concatenate(stats)
    m = Model(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), stat.mean(axis=0), stat.std(axis=0) + 1e-6)
    x_all = m.scale(stat)
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            ids = order[lo : lo + BATCH]
            n = len(ids)
            bucket = np.concatenate([rows[i][0] for i in ids] + [np.tile(np.arange(BUCKETS, size), n)])
            val = np.concatenate([rows[i][1] for i in ids] + [x_all[ids].ravel()])
            at = np.r_[np.repeat(np.arange(n), [len(rows[i][0]) for i in ids]), np.repeat(np.arange(n), N_STATS)]
            sums = np.stack([np.bincount(at, m.v[bucket, f] * val, minlength=n) for f in range(FACTORS)], axis=1)
            z = m.w0 + np.bincount(at, m.w[bucket] * val, minlength=n)
            for f in range(FACTORS):
                z += 0.5 * (sums[:, f] ** 2 - np.bincount(at, (m.v[bucket, f] * val) ** 2, minlength=n))
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[ids]) * weight[ids] / n
            own = np.unique(bucket)
            grad = np.bincount(bucket, d[at] * val, minlength=size)[own] + DECAY * m.w[own]
            gw[own] += grad**2
            m.w[own] -= RATE * grad / np.sqrt(gw[own])
            for f in range(FACTORS):
                grad = np.bincount(bucket, d[at] * val * (sums[at, f] - m.v[bucket, f] * val), minlength=size)[own] + DECAY * m.v[own, f]
                gv[own, f] += grad**2
                m.v[own, f] -= 0.3 * RATE * grad / np.sqrt(gv[own, f])
            g0 += d.sum() ** 2
            m.w0 -= RATE * d.sum() / np.sqrt(g0)
    return m


def _score(model):
    def run(batches):
        for b in batches:
            score = [model.value.score(s) for s in slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model of labels(doc_id, quality) and the texts of docs, learning folds only."""
    own = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("label_doc"), F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in own.where(~held_out("label_doc")).groupBy("quality").count().collect()}
    # Labels are thinned before the join, so that texts of a bounded number of documents are read out.
    draw = F.pmod(F.xxhash64("label_doc", F.lit(13)), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col("quality") == value) & (draw < F.lit(min(1 << 30, (per_label << 30) // n))))
    few = own.where(~held_out("label_doc")).where(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(few), F.col("doc_id") == F.col("label_doc")).select("doc_id", "text", "quality")  # about 2 * per_label ids
    got = rows.where("text is not null").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    total = sum(counts.values())
    return train([(r["text"], r["quality"], counts[r["quality"]] / total) for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    score is the estimated probability of label 1, for null and empty texts
    too (their statistics are 0); predicted is 1 where it is at least 0.5.
    Rows with the same doc_id or text are rows of their own; a null doc_id
    counts as held out. Other columns are ignored; an empty table gives an
    empty result, and a model without both labels a constant.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cols.mapInArrow(_score(shared), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
