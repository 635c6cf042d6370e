"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte 2-, 3- and
4-grams, A-Z lower-cased, hashed into BUCKETS rows); a linear layer and
softmax give the language. Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample, PER_LABEL texts of
each language. One more class stands for texts of no language: generated noise
(tokens as of keys and checksums, random characters, and digits). On a fifth of the sample, held back, a
temperature is fitted to the log-likelihood, which calibrates all
probabilities, and a text is rejected where noise has a probability of at least
the rejection level: SURE, or more if over REJECT of the held-back texts of
a language would get there. Texts of several languages are thus not rejected.

As both steps are linear, a trained model folds into one table with a row of
logits for each bucket; prediction averages its rows over a text's subwords.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, labelled
from .words import slices

PER_LABEL = 700
GRAMS, BUCKETS, DIM = (2, 3, 4), 1 << 15, 16
EPOCHS, RATE, BATCH = 6, 20.0, 64
REJECT, SURE = 0.001, 0.8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the byte n-gram at every place."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, n, np.uint32)
    for j in range(n):
        h = (h ^ data[j : j + size]) * np.uint32(0x01000193 + 0x9E37 * 2 * j)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64)


def _places(offs: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams lie in one row, and how many each row has."""
    count = np.maximum(np.diff(offs) - n + 1, 0)
    ok = np.ones(max(total - n + 1, 0), bool)
    for j in range(1, n):
        at = offs[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok, count


def histograms(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights (of sum 1) of every text."""
    out = []
    for t in texts:
        data = _LOWER[np.frombuffer(t.encode(), np.uint8)]
        c = np.bincount(np.concatenate([buckets(data, n) for n in GRAMS]), minlength=1)
        b = np.flatnonzero(c)
        out.append((b, (c[b] / max(1, c.sum())).astype(np.float32)))
    return out


def noise(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no language, one for each given text and of about its length, in three kinds by turns."""
    ascii_, digits, keys = (list(x) for x in ("".join(map(chr, range(33, 127))), "0123456789.,:;-/ ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="))
    out = []
    for i, t in enumerate(texts):
        size, kind = int(min(max(len(t), 20), 4000)), i % 3
        chars = rng.choice((keys, ascii_, digits)[kind], size)
        blank = np.flatnonzero(rng.random(size) < (0.03, 0.15, 0.1)[kind])
        chars[blank] = " " if kind < 2 else "e"
        out.append("".join(chars))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """table: one row of logits for each bucket, the last column that of noise."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, scale: float, reject: float):
        self.labels, self.table, self.bias, self.scale, self.reject = labels, table, bias, scale, reject

    def judge(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and probability of the likeliest language, and whether the text is rejected as noise."""
        p = softmax((logits + self.bias) * self.scale)
        own = p[:, :-1]
        return own.argmax(axis=1), own.max(axis=1), p[:, -1] >= self.reject


def train(sample: list[tuple[str, str, float]], seed: int = 5) -> Model:
    """A model of (text, label, ...) rows. Without rows, it rejects everything."""
    labels = sorted({x[1] for x in sample})
    if not labels:
        return Model([UNKNOWN], np.zeros((BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    n_noise = -(-len(sample) // len(labels))
    texts = [x[0] for x in sample]
    rows = histograms([*texts, *noise([texts[i] for i in rng.permutation(len(texts))[:n_noise]], rng)])
    classes = len(labels) + 1
    y = np.array([labels.index(x[1]) for x in sample] + [len(labels)] * n_noise)
    order = rng.permutation(len(rows))
    held, used = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 20 else (order, order)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, classes)), np.zeros(classes)
    weight = len(used) / (classes * np.maximum(np.bincount(y[used], minlength=classes), 1))

    def dense(ids):
        """The histograms of a batch as a matrix with a row for each text."""
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for r, i in enumerate(ids):
            x[r, rows[i][0]] = rows[i][1]
        return x

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(used)
        for lo in range(0, len(used), BATCH):
            ids = used[lo : lo + BATCH]
            x = dense(ids)
            hidden = (x @ emb).astype(np.float64)
            p = softmax(hidden @ out + bias)
            p[np.arange(len(ids)), y[ids]] -= 1
            p *= weight[y[ids]][:, None] / len(ids)
            seen = np.flatnonzero(x.any(axis=0))
            emb[seen] -= np.float32(rate) * (x[:, seen].T @ (p @ out.T).astype(np.float32))
            out -= 0.05 * rate * hidden.T @ p
            bias -= 0.05 * rate * p.sum(axis=0)
    z = np.concatenate([dense(held[lo : lo + BATCH]) @ emb for lo in range(0, len(held), BATCH)]) @ out + bias
    right = y[held]

    def loss(scale):
        return -np.log(np.maximum(softmax(z * scale)[np.arange(len(held)), right], 1e-12)).mean()

    scale = min((float(2.0**k) for k in np.arange(-3, 6.01, 0.25)), key=loss)
    worst = np.sort(softmax(z * scale)[right < len(labels), -1])[::-1]
    reject = max(SURE, float(np.nextafter(worst[int(REJECT * len(worst))], 2))) if len(worst) else SURE
    return Model(labels, (emb @ out).astype(np.float32), bias, scale, reject)


def mean_logits(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Average table row over the subwords of every row of a slice."""
    data = _LOWER[data]
    total, n_grams = np.zeros((len(offs) - 1, model.table.shape[1])), np.zeros(len(offs) - 1)
    for n in GRAMS:
        b = buckets(data, n)
        ok, count = _places(offs, n, len(data))
        b = b[ok]
        some = np.flatnonzero(count)
        if len(some):
            begin = (np.cumsum(count) - count)[some]
            for k in range(model.table.shape[1]):
                total[some, k] += np.add.reduceat(model.table[:, k][b], begin, dtype=np.float64)
        n_grams += count
    return total / np.maximum(n_grams, 1)[:, None]


def _predict(model):
    def run(batches):
        m = model.value
        names = np.array(m.labels, object)
        for b in batches:
            texts = b.column("text")
            lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            found = [m.judge(mean_logits(m, s.data, s.offs)) for s in slices(texts)]
            lang = names[np.concatenate([x[0] for x in found])] if found else np.zeros(0, object)
            score = np.concatenate([x[1] for x in found]) if found else np.zeros(0)
            noisy = np.concatenate([x[2] for x in found]) if found else np.zeros(0, bool)
            lang, score = np.where(lettered, lang, UNKNOWN), np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(~lettered | noisy)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model of docs(doc_id, text, lang): rows of the learning folds with a text and a lang."""
    return train(labelled(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "lang", per_label))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of docs.

    lang_pred is one of the learned languages, or `und` with score 0 if the
    text is null or has no letter; score is the calibrated probability.
    rejected is true for `und` and where noise reaches the model's rejection
    level. Texts of any length are taken whole. Rows with the same doc_id or text are rows of their own; a null
    doc_id counts as held out. Without any labelled row everything is `und`.
    Other columns are ignored; an empty table gives an empty result.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cols.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def _accept(model):
    def run(batches):
        m = model.value
        for b in batches:
            keep = []
            texts = b.column("text").cast(pa.string())
            lettered = [t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()]
            for s in slices(texts):
                noisy = m.judge(mean_logits(m, s.data, s.offs))[2]
                keep += [bool(x and not q) for x, q in zip(lettered[s.lo : s.hi], noisy, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are not rejected (`identify`), unchanged.

    Null texts and those without a letter go. Repeated rows and ids are judged
    row by row, columns of any name pass through, and texts of any length are
    taken whole. An empty table gives an empty result.
    """
    model = model or fit(docs)
    return docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
