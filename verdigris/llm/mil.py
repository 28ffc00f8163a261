"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages of PASSAGE words. Each passage is encoded as shares of byte classes, of hashed bytes-in-context and of
word shapes, projected by a learned layer; gated attention (tanh times sigmoid) weighs the passages, and the weighted mean is
scored by a logistic unit. Weights are learned by Adam on the driver from a bounded sample of labelled documents; scoring is one pass
of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Words, slices, utf8

#: Words in a passage; most labelled documents that train the model; hidden units; units of the attention.
PASSAGE, MAX_TRAINING_DOCS, HIDDEN, ATTENTION = 128, 4000, 16, 8
PAIR_SLOTS = 64
WIDTH = 16 + PAIR_SLOTS + 6
PREDICT_FROM = 0.7


def _classes() -> np.ndarray:
    """16 classes of bytes."""
    out = np.full(256, 15, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[b] = 14
        elif c in "aeiou":
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in " \t\r\v\f":
            out[b] = 4
        elif c == "\n":
            out[b] = 5
        elif c in ".,":
            out[b] = 6
        elif c in ";:'\"()-":
            out[b] = 7
        elif c == "!":
            out[b] = 8
        elif c == "?":
            out[b] = 9
        elif c in "#*":
            out[b] = 10
        elif c in "$%&":
            out[b] = 11
        elif c in "|<>":
            out[b] = 12
        elif c in "@_=/\\{}[]+~^`":
            out[b] = 13
    return out


CLASSES = _classes()


def encode(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH features, number of passages of each text); a text without words is one passage of zeros."""
    w = Words(raw, off, lower=False)
    n_words = np.diff(w.first)
    count = np.maximum(-(-n_words // PASSAGE), 1)
    base = np.cumsum(count) - count
    total = int(count.sum())
    passage = base[w.row] + (np.arange(len(w.hash)) - w.first[w.row]) // PASSAGE
    x = np.zeros((total, WIDTH), np.float32)
    if not len(w.hash):
        return x, count
    # a byte belongs to the passage of the last word that began before it
    own = np.cumsum(np.bincount(w.start, minlength=len(w.data))) - 1
    text = np.repeat(np.arange(w.n_rows), np.diff(w.off))
    owner = np.where((own >= 0) & (w.row[np.maximum(own, 0)] == text), passage[np.maximum(own, 0)], base[text])
    cls = CLASSES[w.data].astype(np.int64)
    size = np.maximum(np.bincount(owner, minlength=total), 1)[:, None]
    x[:, :16] = np.bincount(owner * 16 + cls, minlength=total * 16).reshape(total, 16) / size
    pair = (cls[:-1] * 16 + cls[1:]) * 40503 >> 4 & PAIR_SLOTS - 1
    same = owner[:-1] == owner[1:]
    x[:, 16 : 16 + PAIR_SLOTS] = np.bincount(owner[:-1][same] * PAIR_SLOTS + pair[same], minlength=total * PAIR_SLOTS).reshape(total, PAIR_SLOTS) / size
    words = np.maximum(np.bincount(passage, minlength=total), 1)
    length = w.end - w.start
    order = np.lexsort((w.hash, passage))
    repeated = np.zeros(len(order), bool)
    repeated[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    follows = np.zeros(len(passage), bool)
    follows[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    ends = w.data[w.end - 1]
    upper = (w.data[w.start] >= 65) & (w.data[w.start] <= 90)
    extra = [np.bincount(passage, v, total) / words for v in (length / 10.0, repeated_in(order, repeated), follows, np.isin(ends, list(b"#*$%&|<>!")), upper, length <= 2)]
    x[:, 16 + PAIR_SLOTS :] = np.stack(extra, 1)
    return x, count


def repeated_in(order: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), bool)
    out[order] = repeated
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Weights: standardisation, encoder (W, c), attention (V, U, a), scorer (s, b)."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        z = (x - p["mean"]) / p["std"]
        h = np.tanh(z @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        weight = np.exp(e - top[bag])
        weight /= np.bincount(bag, weight, n)[bag]
        pooled = np.zeros((n, h.shape[1]))
        np.add.at(pooled, bag, weight[:, None] * h)
        return z, h, t, g, weight, pooled, sigmoid(pooled @ p["s"] + p["b"])

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, np.repeat(np.arange(len(count)), count), len(count))[-1]

    @classmethod
    def fit(cls, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 5e-3, ridge: float = 1e-4, seed: int = 3) -> Attention:
        random = np.random.default_rng(seed)
        p = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "W": random.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "c": np.zeros(HIDDEN), "V": random.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": random.normal(0, 0.3, (HIDDEN, ATTENTION)), "a": random.normal(0, 0.3, ATTENTION), "s": random.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
        model, learned = cls(p), ("W", "c", "V", "U", "a", "s", "b")
        first = np.cumsum(count) - count
        m, v, step = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
        for _ in range(epochs):
            order = random.permutation(len(count))
            for lo in range(0, len(order), batch):
                docs = order[lo : lo + batch]
                rows = np.concatenate([np.arange(first[d], first[d] + count[d]) for d in docs])
                bag = np.repeat(np.arange(len(docs)), count[docs])
                z, h, t, g, weight, pooled, out = model.forward(x[rows], bag, len(docs))
                d = (out - y[docs]) / len(docs)
                dp = d[:, None] * p["s"]
                inner = (dp[bag] * h).sum(1)
                de = weight * (inner - np.bincount(bag, weight * inner, len(docs))[bag])
                dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
                dh = (weight[:, None] * dp[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grads = {"W": z.T @ dh, "c": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "s": pooled.T @ d, "b": d.sum(keepdims=True)}
                step += 1
                for k in learned:
                    grad = grads[k] + ridge * p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model


def fit_quality(training: DataFrame, text: str = "text", label: str = "quality", order: str = "doc_id", most: int = MAX_TRAINING_DOCS) -> Attention:
    """Fit on at most `most` labelled documents, those first by a hash of `order`. Spark encodes them; only features reach the driver."""
    sample = training.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(order), F.lit(11)).alias("h"), F.col(order).alias("o"))
    sample = sample.orderBy("h", "o").limit(most).drop("h", "o")

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(0))
            for lo, hi in slices(off):
                x, count = encode(raw, off[lo : hi + 1])
                start = np.cumsum(count) - count
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array([x[s : s + c].tobytes() for s, c in zip(start.tolist(), count.tolist())], pa.binary())], names=["y", "x"])

    got = sample.mapInArrow(run, "y double, x binary").toPandas()
    if got.empty:
        x, count, y = np.zeros((1, WIDTH), np.float32), np.ones(1, np.int64), np.ones(1)
    else:
        bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
        x, count, y = np.concatenate(bags), np.array([len(b) for b in bags]), got["y"].to_numpy()
    return Attention.fit(x, count, y)


def score_quality(docs: DataFrame, model: Attention, text: str = "text") -> DataFrame:
    """All columns of `docs` and score double (0 to 1, higher: a good text is likelier).

    Null and empty texts get the score of an empty passage; long texts are read whole; repeated rows score alike; an empty table
    gives an empty result; a column `score` is replaced. No other column takes part.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model.p)
    at, names = docs.columns.index(text), [*docs.columns, "score"]
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        model = Attention(sent.value)
        for b in batches:
            raw, off = utf8(b.column(at))
            for lo, hi in slices(off):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(*encode(raw, off[lo : hi + 1])).astype(float))], names=names)

    return docs.mapInArrow(run, schema)


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = MAX_TRAINING_DOCS) -> DataFrame:
    """Texts and labels of at most `most` labelled rows that are not held out; the sample of keys, of that size at most, is broadcast."""
    usable = labels.filter(F.col("quality").isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(True))).select(key, "quality").dropDuplicates([key])
    sample = usable.orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(most)
    return docs.select(key, "text").join(F.broadcast(sample), key)
