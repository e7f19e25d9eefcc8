"""Attention-based multiple-instance quality classifier.

Every text is a bag of passages of ``WORDS`` words (the last one may be shorter). A passage is encoded by byte-class
shares, hashed byte pairs and repetition figures, then h = tanh(W x). Gated attention a ~ exp(w . (tanh(V h) *
sigmoid(U h))), learned from document labels alone, weights the passages; the score is sigmoid(c . sum(a h) + b).

Training uses a bounded sample, at most ``MAX_TRAIN`` labelled texts in hash order of their ids; all passages of all
texts are scored. Edge cases: null and empty texts are one empty passage; ids may be null (never learned from,
``held_out`` true) or repeated; null labels are ignored, labels that
contradict one another all count; without both labels in the sample the score is the smoothed
share of the one seen; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.arrow import by_slices, groups
from scatterspark.llm.common import fold, table

MAX_TRAIN = 6_000
WORDS = 50
PAIRS = 32
HIDDEN, GATE = 24, 12

_CLASS = np.full(256, 6)  # other signs
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[32, 10, 9, 13]] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[ord("|")] = 5
_CLASS[128:160] = 7
_CLASS[160:192] = 8
_CLASS[192:] = 9
CLASSES = 10
DIM = CLASSES + PAIRS + 5


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passages by features, and the number of passages of each text."""
    parts, sizes, own = [], [], []
    for t in texts:
        words = (t or "").split()
        n = 0
        for i in range(0, len(words) or 1, WORDS):
            p = words[i : i + WORDS]
            s = " ".join(p).encode("utf-8", "replace") or b" "
            k = max(1, len(p))
            own.append((len(set(p)) / k, len(set(s.lower().split())) / k, len(s) / k / 10, len(p) / WORDS, len(set(s)) / 64))
            parts.append(s)
            n += 1
        sizes.append(n)
    buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    length = np.array([len(p) for p in parts])
    _, of = groups(length)
    share = np.bincount(of * CLASSES + _CLASS[buf], minlength=len(parts) * CLASSES).reshape(-1, CLASSES) / length[:, None]
    pair = (buf[:-1] * 37 + buf[1:] * 11) % PAIRS
    same = of[:-1] == of[1:]
    pairs = np.bincount((of[:-1] * PAIRS + pair)[same], minlength=len(parts) * PAIRS).reshape(-1, PAIRS) / length[:, None]
    return np.hstack([share, pairs, np.array(own)]).astype(np.float32), np.array(sizes)


class Model:
    def __init__(self, mean, std, params):
        self.mean, self.std, self.params = mean, std, params

    def attention(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention of every passage and score of every text."""
        w, b, v, u, g, c, d = self.params
        h = np.tanh((x - self.mean) / self.std @ w + b)
        starts, of = groups(sizes)
        e = (np.tanh(h @ v) / (1 + np.exp(-h @ u))) @ g
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return a, 1 / (1 + np.exp(-np.clip(z @ c + d, -40, 40)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.attention(*encode(texts))[1].astype(np.float64)


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, l2: float = 1e-4, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        zero = [np.zeros(s) for s in ((DIM, HIDDEN), HIDDEN, (HIDDEN, GATE), (HIDDEN, GATE), GATE, HIDDEN)]
        return Model(np.zeros(DIM), np.ones(DIM), [*zero, np.log(p / (1 - p))])
    mean, std = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / std
    starts, _ = groups(sizes)
    P = [rng.normal(0, s[0] ** -0.5, s) for s in ((DIM, HIDDEN), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,))]
    w, v, u, g, c = P
    P = [w, np.zeros(HIDDEN), v, u, g, c, np.zeros(1)]
    M, V, t = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P], 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            k = order[lo : lo + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in k])
            st, of = groups(sizes[k])
            w, b, v, u, g, c, d = P
            xi = x[rows]
            h = np.tanh(xi @ w + b)
            tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-h @ u))
            e = (tv * su) @ g
            e = np.exp(e - np.maximum.reduceat(e, st)[of])
            a = e / np.add.reduceat(e, st)[of]
            z = np.add.reduceat(a[:, None] * h, st)
            p = 1 / (1 + np.exp(-np.clip(z @ c + d, -40, 40)))
            r = (p - y[k]) * weight[k] / len(k)
            dz = r[:, None] * c
            da = (dz[of] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, st)[of])
            dtv, dsu = de[:, None] * g * su * (1 - tv**2), de[:, None] * g * tv * su * (1 - su)
            dh = (a[:, None] * dz[of] + dtv @ v.T + dsu @ u.T) * (1 - h**2)
            grads = [xi.T @ dh, dh.sum(0), h.T @ dtv, h.T @ dsu, (tv * su).T @ de, z.T @ r, r.sum(keepdims=True)]
            t += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for i, q in enumerate(grads):
                q = q + l2 * P[i]
                M[i], V[i] = 0.9 * M[i] + 0.1 * q, 0.999 * V[i] + 0.001 * q * q
                P[i] = P[i] - rate * (M[i] / (1 - 0.9**t)) / (np.sqrt(V[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, std, [*P[:-1], float(P[-1][0])])


def _encoded(keys, texts):
    x, sizes = encode(texts)
    starts, _ = groups(sizes)
    return {"y": keys, "x": [x[s : s + n].tobytes() for s, n in zip(starts, sizes)]}


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_train: int = MAX_TRAIN) -> Model:
    """Learns from labelled texts whose fold isn't 0, at most ``max_train`` of them."""
    sample = (
        labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .select("doc_id", F.col(label).cast("long").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_train)
    )
    arrow = pa.schema([("y", pa.int64()), ("x", pa.binary())])
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(by_slices(_encoded, arrow), "y long, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.x), bytes(r.x), r.y))  # the same order however the tables are dealt out
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, DIM) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, DIM), np.float32)
    return train(x, np.array([len(b) for b in bags], dtype=int), np.array([r.y for r in rows]))


def score(documents: DataFrame, model: Model, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some KB

    def fn(keys, texts):
        s = shared.value.scores(texts)
        return {"doc_id": keys, "score": s, "predicted": (s >= threshold).astype(np.int32)}

    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    out = documents.select("doc_id", "text").mapInArrow(by_slices(fn, arrow), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
