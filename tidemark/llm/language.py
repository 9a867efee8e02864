"""Language of texts by a convolutional network over bytes.

Filters of several widths slide over the bytes of a fixed-length window; each filter's largest value feeds a softmax.
Training is numpy: labelled texts of a bounded sample are cut into windows and the network learns by stochastic
gradients (Adam), which pass through the one position that gave each maximum. A text is predicted from all its windows:
their log-probabilities are averaged by the bytes they hold. Bytes are discrete, so a filter's value is a sum of table
entries; for prediction these are folded into tables over byte pairs.

Null texts and texts without a letter give `und` and score 0. Rows with a null label are never learnt from. The last
window is filled up with zero bytes. Every draw comes from a fixed seed and the sample is chosen by hash, so equal tables
give equal models. With no labelled row at all, every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass

#: Labelled documents per language that are learnt from: the bound on what the driver gathers.
DOCS_PER_LANGUAGE = 500
WINDOWS_PER_DOC = 4
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EPOCHS = 5
CHUNK = 1 << 15
UNKNOWN = "und"


def windows(raw: bytes) -> np.ndarray:
    """All of a text in rows of WINDOW bytes, the last one filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNet:
    """Weights: per width a table (offset, byte, filter) and a bias; then one softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of every filter per window, and where it stands."""
        values, at = [], []
        for w, table in zip(WIDTHS, self.conv, strict=True):
            span = x.shape[1] - w + 1
            v = sum(table[k][x[:, k:k + span]] for k in range(w))
            best = v.argmax(1)
            at.append(best)
            values.append(np.take_along_axis(v, best[:, None, :], 1)[:, 0, :])
        return np.concatenate(values, 1), at

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.dense, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                xb, yb = x[rows], y[rows]
                h, at = self.pooled(xb)
                z = h @ self.dense + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back, grads = p @ self.dense.T, []
                for j, (w, table) in enumerate(zip(WIDTHS, self.conv, strict=True)):
                    g, part = np.zeros_like(table), back[:, j * FILTERS:(j + 1) * FILTERS]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, at[j] + k, 1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [h.T @ p, p.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def folded(self) -> np.ndarray:
        """Pair tables side by side: width 2, the first pair of 3, the first and the second pair of 4."""
        two, three, four = self.conv
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])], 1)

    def log_probabilities(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        f, out = FILTERS, []
        for rows in range(0, len(x), max(1, CHUNK // WINDOW)):
            b = x[rows:rows + max(1, CHUNK // WINDOW)]
            v = pairs[b[:, :-1].astype(np.int32) * 256 + b[:, 1:]]
            three = v[:, :-1, f:2 * f] + self.conv[1][2][b[:, 2:]]
            four = v[:, :-2, 2 * f:3 * f] + v[:, 2:, 3 * f:]
            h = np.concatenate([v[:, :, :f].max(1), three.max(1), four.max(1)], 1)
            z = h @ self.dense + self.bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, which are never learnt from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> ByteNet | None:
    """A network trained on at most DOCS_PER_LANGUAGE labelled documents of each language."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("text").cast("string"), "lang", F.xxhash64("doc_id").alias("h"))
    by = Window.partitionBy("lang").orderBy("h")
    rows = learn.withColumn("r", F.row_number().over(by)).where(F.col("r") <= DOCS_PER_LANGUAGE).select("text", "lang", "h").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    classes = sorted({r["lang"] for r in rows})
    if not classes:
        return None
    rng, xs, ys = np.random.default_rng(3), [], []
    for r in rows:
        w = windows(r["text"].encode())
        w = w[rng.permutation(len(w))[:WINDOWS_PER_DOC]]
        xs.append(w)
        ys += [classes.index(r["lang"])] * len(w)
    net = ByteNet(classes)
    net.train(np.concatenate(xs), np.array(ys))
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; only the text is looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    held: list = []

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        if model is not None and not held:
            held.append(model.folded())
        langs, scores = [], []
        for text in batch.column(2).to_pylist():
            if model is None or not text or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            raw = text.encode()
            x = windows(raw)
            weight = np.full(len(x), WINDOW, np.float64)
            weight[-1] = len(raw) - WINDOW * (len(x) - 1)
            mean = (model.log_probabilities(x, held[0]) * weight[:, None]).sum(0) / weight.sum()
            p = np.exp(mean - mean.max())
            k = int(p.argmax())
            langs.append(model.classes[k])
            scores.append(float(p[k] / p.sum()))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return arrow_pass(rows, one, "doc_id long, held_out boolean, lang_pred string, score double")
