"""Benchmark decontamination by spaced-seed hashing.

Texts become words: lower-cased runs of letters, digits and ``_``. A spaced seed hashes the words at the positions of a
fixed mask and ignores those between. Seeds of the benchmark and of the documents are joined on their hash, and every
hit is verified along its diagonal (document position minus item position).

An item is found in a document if, on one diagonal, a stretch of ``SPAN`` = 13 words of the item equals the document's
in at least 11 positions. Shorter items must occur from end to end: those of 7 to 12 words with one word replaced at
most, those of up to 6 words as they are. The three masks are fully sensitive to two replaced words of 13: one of them
fits between the two; the two halves that serve as masks for 7 to 12 words are so for one. Very short items are found in
many documents; ``shortest`` leaves out those of fewer words where that isn't wanted.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words, with one pass over the documents for each,
so what is broadcast is bounded; documents are never shuffled, so an item that a third of them contain is no hot key.

Edge cases: null and empty texts, on either side, match nothing; repeated items or documents give their rows each;
null ids are kept as null; without benchmark items or documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.arrow import by_slices
from scatterspark.llm.common import table
from scatterspark.llm.shingles import mix, word_hashes

SPAN, EQUAL = 13, 11
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 7, 8, 9, 10), (0, 1, 2, 3, 5, 7, 8))
BLOCK_WORDS = 1_000_000
_BITS = 22
_SIGNS = re.compile(r"\W+")
_STEP = 0x9E3779B97F4A7C15


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([_SIGNS.sub(" ", t.lower()) if t else "" for t in texts])


def seeds(h: np.ndarray, counts: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of one mask, and the positions (in ``h``) that they start from."""
    span = mask[-1] + 1
    end = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(h)) + span <= end)
    out = np.zeros(len(at), np.uint64)
    factor = sum(1 << m for m in mask) * 2 + 1
    for m in mask:
        factor = factor * _STEP % (1 << 64)
        out += h[at + m] * np.uint64(factor)
    return mix(out), at


def replaceable(n: int) -> int:
    """Words of an item, or of ``SPAN`` of its words, that may differ."""
    return min(n, SPAN) * (SPAN - EQUAL) // SPAN


def masks_of(n: int) -> list[tuple[int, ...]]:
    """Masks for items of n words, n below ``SPAN``."""
    return [tuple(range(n // 2)), tuple(range(n // 2, n))] if replaceable(n) else [tuple(range(n))]


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.h, self.counts = words(texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)
        item = np.repeat(np.arange(len(ids)), self.counts)
        self.masks = []
        long = self.counts >= SPAN
        lengths = sorted({int(n) for n in self.counts if 0 < n < SPAN})
        for mask, chosen in [(m, long) for m in MASKS] + [(m, self.counts == n) for n in lengths for m in masks_of(n)]:
            s, at = seeds(self.h, self.counts, mask)
            s, at = s[chosen[item[at]]], at[chosen[item[at]]]
            order = np.argsort(s, kind="stable")
            s, at = s[order], at[order]
            bits = np.zeros(1 << _BITS, bool)
            bits[(s >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.masks.append((mask, s, at, np.packbits(bits)))
        self.item = item

    def hits(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) rows, diagonals in positions of ``h``."""
        found = []
        for mask, s, at, bits in self.masks:
            if not len(s):
                continue
            mine, where = seeds(h, counts, mask)
            slot = (mine >> np.uint64(64 - _BITS)).astype(np.int64)
            maybe = np.flatnonzero((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            mine, where = mine[maybe], where[maybe]
            lo, hi = np.searchsorted(s, mine, "left"), np.searchsorted(s, mine, "right")
            n = hi - lo
            k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n).astype(np.int64) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            start = at[k]
            item = self.item[start]
            found.append(np.stack([item, np.repeat(where, n) - (start - self.first[item])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verify(self, item: int, diagonal: int, h: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Item positions that a qualifying stretch covers and that equal the document's words in h[lo:hi]."""
        n = int(self.counts[item])
        if n < SPAN and not lo <= diagonal <= hi - n:
            return np.zeros(0, np.int64)
        a, b = max(0, lo - diagonal), min(n, hi - diagonal)
        equal = np.zeros(n, bool)
        equal[a:b] = self.h[self.first[item] + a : self.first[item] + b] == h[diagonal + a : diagonal + b]
        length = min(SPAN, n)
        ok = np.convolve(equal, np.ones(length, int), "valid") >= length - replaceable(n)
        covered = np.convolve(ok, np.ones(length, int)) > 0
        return np.flatnonzero(covered & equal)


def _blocks(benchmark: DataFrame, most: int, shortest: int):
    ids, texts, used = [], [], 0
    for item_id, text in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(_SIGNS.sub(" ", text).split()) if text else 0
        if n < max(1, shortest):
            continue
        if ids and used + n > most:
            yield ids, texts
            ids, texts, used = [], [], 0
        ids.append(item_id)
        texts.append(text)
        used += n
    if ids:
        yield ids, texts


def contaminated(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """``(doc_id, item_id, n_equal, n_words, first, last)``: items found in documents.

    ``n_equal`` counts the item's words that verified stretches share with the document, ``first`` and ``last`` are the
    outermost of them, ``n_words`` is the item's length.
    """
    spark = documents.sparkSession
    names = ["doc_id", "item_id", "n_equal", "n_words", "first", "last"]
    arrow = pa.schema([(n, pa.int64()) for n in names])
    out = spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    for ids, texts in _blocks(benchmark, block_words, shortest):
        shared = spark.sparkContext.broadcast(Index(ids, texts))

        def fn(keys, docs, shared=shared):
            index = shared.value
            h, counts = words(docs)
            last = np.cumsum(counts)
            rows = {}
            for item, diagonal in index.hits(h, counts).tolist():
                lo, hi = max(diagonal, 0), diagonal + int(index.counts[item])
                d = int(np.searchsorted(last, lo, "right"))  # the diagonal may start in the document before
                while d < len(last) and last[d] - counts[d] < hi:
                    if len(p := index.verify(item, diagonal, h, last[d] - counts[d], last[d])):
                        rows.setdefault((d, item), []).append(p)
                    d += 1
            cols = {n: [] for n in names}
            for (d, item), p in rows.items():
                p = np.unique(np.concatenate(p))
                for n, v in zip(names, (keys[d], index.ids[item], len(p), int(index.counts[item]), int(p[0]), int(p[-1]))):
                    cols[n].append(v)
            return cols

        found = documents.select("doc_id", "text").where(F.col("text").isNotNull())
        out = out.union(found.mapInArrow(by_slices(fn, arrow), out.schema))
    return out


def query(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
