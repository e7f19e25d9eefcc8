"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of hashed words and word beginnings. Training pairs every labelled text that
mentions an identity term with copies in which that term is swapped for another one of its set, and penalises the
squared difference of the two scores (before the sigmoid). A term thus can't carry a score of its own, which lowers
false positives on neutral mentions.

Training uses a bounded sample, at most ``MAX_TRAIN`` labelled texts in hash order of their ids; all texts are scored,
in whole. Edge cases: null and empty texts get the score of a text without features; ids may be null (never learned
from, ``held_out`` null -> true) or repeated (one row each); labels that are null are ignored, those that contradict one another all count; without both labels in
the sample the score is the smoothed share of the one seen; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.arrow import by_slices, groups
from scatterspark.llm.common import fold, table

MAX_TRAIN = 12_000
BITS = 20
WORD = re.compile(r"[^\W\d_]+")

#: Sets of terms that may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab", "european"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden"), ("schwarze", "weiße"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "árabes"),
)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def features(words: set[str]) -> set[int]:
    """Hashed words, and their first 4 and 5 letters where they are longer."""
    return {_hash(w) for w in words} | {_hash("^" + w[:4]) for w in words if len(w) > 4} | {_hash("^" + w[:5]) for w in words if len(w) > 5}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactuals(words: set[str], sets=IDENTITY_TERMS) -> list[set[str]]:
    """The word sets after swapping each identity term for every other one of its set."""
    return [(words - {a}) | {b} for s in sets for a in s if a in words for b in s if b != a]


class Model:
    """Weights over the hashed features and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, float(bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hot = {}  # word -> weight of the word alone, beginnings are kept apart as words share them
        z = np.empty(len(texts))
        w = self.weights
        for i, t in enumerate(texts):
            ids = set()
            for word in words_of(t):
                f = hot.get(word)
                if f is None:
                    f = hot[word] = [x for x in features({word}) if w[x]]
                if f:
                    ids.update(f)
            z[i] = sum(w[list(ids)].tolist()) if ids else 0.0
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def train(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], weight: float = 10.0, l2: float = 1e-4, steps: int = 250) -> Model:
    """``rows``: feature numbers of each text; ``pairs``: numbers only in a text and only in its counterfactual."""
    dim = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dim, np.float32), np.log(p / (1 - p)))
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    _, doc = groups(sizes)
    n1, n0 = y.sum(), len(y) - y.sum()
    c = np.bincount(flat, minlength=dim)
    c1 = np.bincount(flat[y[doc] == 1], minlength=dim)
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c - c1 + 0.5) / (n0 - c + c1 + 0.5))
    z = odds / np.sqrt(1 / (c1 + 0.5) + 1 / (c - c1 + 0.5))
    keep = (c >= 3) & (np.abs(z) > 2.5)
    number = np.full(dim, -1)
    for a, b in pairs:
        keep[a] = keep[b] = True
    ids = np.flatnonzero(keep)
    number[ids] = np.arange(len(ids))
    used = keep[flat]
    col, doc = number[flat[used]], doc[used]
    pcol = np.concatenate([number[np.concatenate(p)] for p in pairs] or [np.zeros(0, int)])
    psign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs] or [np.zeros(0)])
    prow = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    w, bias = np.zeros(len(ids)), np.log(n1 / n0)
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], len(y)) + bias, -40, 40)))
        r = (p - y) / len(y)
        g = np.bincount(col, r[doc], len(ids)) + l2 * w
        if len(pairs):
            d = np.bincount(prow, psign * w[pcol], len(pairs)) * (2 * weight / len(pairs))
            g += np.bincount(pcol, psign * d[prow], len(ids))
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(dim, np.float32)
    out[ids] = np.where(np.abs(w) > 1e-3, w, 0)
    return Model(out, bias)


def _encode(keys: list, texts: list) -> dict:
    x, only, swap = [], [], []
    for t in texts:
        words = words_of(t)
        f = features(words)
        others = [features(s) for s in counterfactuals(words)]
        x.append(np.array(sorted(f), np.int32).tobytes())
        only.append([np.array(sorted(f - o), np.int32).tobytes() for o in others])
        swap.append([np.array(sorted(o - f), np.int32).tobytes() for o in others])
    return {"y": keys, "x": x, "only": only, "swap": swap}


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, max_train: int = MAX_TRAIN, **options) -> Model:
    """Learns from labelled texts whose fold isn't 0, at most ``max_train`` of them."""
    sample = (
        labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .select("doc_id", F.col(label).cast("long").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_train)
    )
    schema = "y long, x binary, only array<binary>, swap array<binary>"
    arrow = pa.schema([("y", pa.int64()), ("x", pa.binary()), ("only", pa.list_(pa.binary())), ("swap", pa.list_(pa.binary()))])
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(by_slices(_encode, arrow), schema).collect()
    rows.sort(key=lambda r: (zlib.crc32(r.x), bytes(r.x), r.y))  # the same order however the tables are dealt out
    ints = lambda b: np.frombuffer(b, np.int32)
    pairs = [(ints(a), ints(b)) for r in rows for a, b in zip(r.only, r.swap)]
    return train([ints(r.x) for r in rows], np.array([r.y for r in rows]), pairs, **options)


def score(documents: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def fn(keys, texts):
        s = shared.value.scores(texts)
        return {"doc_id": keys, "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    out = documents.select("doc_id", "text").mapInArrow(by_slices(fn, arrow), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
