"""Language identification with a blended-spectrum string kernel.

k(s, t) = |G(s) & G(t)| / sqrt(|G(s)| |G(t)|), where G(s) is the set of n-grams of s for n = 1..``MAX_N`` (presence, no
counts), over the UTF-8 bytes of the lower-cased text with everything but letters turned to blanks; n-grams are hashed
to ``DIM`` numbers. ``LANDMARKS`` training texts give the Nyström map phi(s) = k(s, landmarks) K^(-1/2), and
one-versus-rest kernel ridge regression is solved on phi. As phi is linear in the presence vector, landmarks, K^(-1/2)
and the ridge weights multiply out to one DIM x languages matrix, and texts are scored by batched matrix products.

Training uses a bounded sample: about ``PER_LANGUAGE`` texts of each language, by hash of their ids, and all languages
there are; the model has DIM numbers a language. All texts are scored, in whole. Edge cases: null texts and texts
without a letter are ``und`` with score 0; null languages and ids are never learned from (a null id is ``held_out``);
ids may repeat; without any training text everything is ``und``; other columns are ignored.
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

MAX_N, DIM = 4, 1 << 15
#: A text resembles a language if its n-grams are at least MARGIN times as usual as those of the LOW quantile of training
#: texts (a few of which may have the wrong language);
#: texts with fewer than JUDGED n-grams can't be told.
MARGIN, LOW, JUDGED = 0.8, 0.1, 60
PER_LANGUAGE, LANDMARKS, RIDGE = 500, 256, 1e-3
LETTER = re.compile(r"[^\W\d_]")

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def presence(texts: list[str | None]) -> np.ndarray:
    """Texts by DIM, whether an n-gram with that hash occurs."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    _, of = groups(np.array([len(r) for r in raw]))
    buf = _KEEP[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    out = np.zeros(len(raw) * DIM, bool)
    base = of * DIM
    gram = np.zeros(len(buf), np.uint32)
    for n in range(1, MAX_N + 1):
        gram = gram[: len(buf) - n + 1] * np.uint32(257) + buf[n - 1 :]
        h = ((gram + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(17)
        inside = of[: len(h)] == of[n - 1 :]
        out[(base[: len(h)] + h)[inside]] = True
    return out.reshape(len(raw), DIM)


def normalised(p: np.ndarray) -> np.ndarray:
    x = p.astype(np.float32)
    return x / np.sqrt(np.maximum(1, p.sum(1, dtype=np.int64)))[:, None].astype(np.float32)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, usual: np.ndarray | None = None, least: np.ndarray | None = None):
        self.languages, self.weights, self.bias, self.usual, self.least = languages, weights, bias, usual, least

    def unlike(self, texts: list[str | None]) -> np.ndarray:
        """Whether a text has no letter or its n-grams are too unusual in every language; scores sum to 1 and can't say so."""
        out = np.array([not self.languages or t is None or LETTER.search(t) is None for t in texts], bool)
        if self.usual is not None and not out.all():
            p = presence([t for t, o in zip(texts, out) if not o])
            n = p.sum(1)
            out[~out] = (n >= JUDGED) & ((p.astype(np.float32) @ self.usual) / np.maximum(1, n)[:, None] < self.least).all(1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(self.languages) and t is not None and LETTER.search(t) is not None for t in texts])
        langs, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if known.any():
            f = normalised(presence([t for t, k in zip(texts, known) if k])) @ self.weights + self.bias
            langs[known] = np.array(self.languages, object)[f.argmax(1)]
            score[known] = np.clip(f.max(1), 0, 1)
        return list(langs), score


def train(packed: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``packed``: presence bits of each training text, in an order in which any prefix is a fair sample."""
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    names = sorted(set(langs))
    bits = lambda rows: normalised(np.unpackbits(np.array([np.frombuffer(r, np.uint8) for r in rows]), axis=1))
    order = []
    for n in names:  # landmarks in turn from each language
        order += [(k, i) for k, i in enumerate(i for i, x in enumerate(langs) if x == n)]
    picked = [i for _, i in sorted(order)[:landmarks]]
    L = bits([packed[i] for i in picked])
    value, vector = np.linalg.eigh((L @ L.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([bits(packed[i : i + 256]) @ L.T for i in range(0, len(packed), 256)]) @ root
    y = np.array([[float(x == n) for n in names] for x in langs])
    weight = np.array([1 / langs.count(n) for n in names])[[names.index(x) for x in langs]]
    weight = weight / weight.sum()
    mean, ymean = weight @ phi, weight @ y
    a, b = phi - mean, y - ymean
    alpha = np.linalg.solve((a * weight[:, None]).T @ a + ridge * np.eye(a.shape[1]), (a * weight[:, None]).T @ b)
    usual, least = np.zeros((DIM, len(names)), np.float32), np.full(len(names), np.inf)
    for k, n in enumerate(names):
        mine = [r for r, x in zip(packed, langs) if x == n]
        part = lambda i: np.unpackbits(np.array([np.frombuffer(r, np.uint8) for r in mine[i : i + 256]]), axis=1).astype(np.float32)
        count = sum(part(i).sum(0) for i in range(0, len(mine), 256))
        usual[:, k] = count / len(mine)
        own = []
        for i in range(0, len(mine), 256):  # each text against the others
            p = part(i)
            size = p.sum(1)
            own.append(((p @ count - size) / max(1, len(mine) - 1) / np.maximum(1, size))[size >= JUDGED])
        if len(own := np.concatenate(own)):
            least[k] = MARGIN * np.quantile(own, LOW)
    least[np.isinf(least)] = 0  # nothing to judge by
    return Model(names, (L.T @ (root @ alpha)).astype(np.float32), (ymean - mean @ alpha).astype(np.float32), usual, least)


def fit(documents: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, **options) -> Model:
    """Learns from texts with a language whose fold isn't ``held``."""
    d = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    rate = d.groupBy(F.col("lang").alias("l")).agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("rate"))  # a row for each language
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    fn = lambda keys, texts: {"lang": keys, "x": [np.packbits(presence([t])[0]).tobytes() for t in texts]}
    arrow = pa.schema([("lang", pa.string()), ("x", pa.binary())])
    rows = d.join(F.broadcast(rate), (F.col("lang") == F.col("l")) & (uniform < F.col("rate"))).select("lang", "text").mapInArrow(by_slices(fn, arrow), "lang string, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.x), r.lang))
    return train([bytes(r.x) for r in rows], [r.lang for r in rows], **options)


def identify(documents: DataFrame, model: Model, folds: int = 4, held: int = 2) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats

    def fn(keys, texts):
        langs, score = shared.value.predict(texts)
        return {"doc_id": keys, "lang_pred": langs, "score": score}

    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    out = documents.select("doc_id", "text").mapInArrow(by_slices(fn, arrow, size=128), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out"), "lang_pred", "score")


def unlike(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id)`` of the texts that resemble no learned language."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def fn(keys, texts):
        return {"doc_id": [k for k, u in zip(keys, shared.value.unlike(texts)) if u]}

    return documents.select("doc_id", "text").mapInArrow(by_slices(fn, pa.schema([("doc_id", pa.int64())]), size=128), "doc_id long")


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))
