"""Optimal length buckets by dynamic programming, then token-budget batches inside each bucket.

1. Lengths of all texts give one global histogram. Lengths up to ``EXACT`` have a bin each, longer ones 128 bins per
   power of two, so the histogram has a fixed number of bins whatever the input. A bin keeps its longest length and the
   sum of its lengths.
2. Dynamic programming over the bins chooses ``n_buckets`` boundaries, longest lengths of bins, with the least padding,
   which is counted exactly. Only a boundary inside a bin of several lengths could pad less: by less than 1/128 of the
   lengths in that bin.
3. A batch of a bucket with boundary b holds ``max(1, budget // b)`` texts, each padded to b. Texts get consecutive
   slots in (shard, id) order; the shards of a bucket (about ``SHARD`` texts each, by hash) bound what one task sorts,
   and prefix sums of shard counts make the slots of a bucket gapless, so only its last batch can be short.

Edge cases: null and empty texts have length 0; a text longer than the budget has a batch of its own; equal ids are
ordered arbitrarily among themselves; null ids are spread over shards by length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterspark.llm.common import cut, table

EXACT, SHARD = 256, 4096


def n_words(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def bin_edge(n: Column) -> Column:
    """Upper edge of the bin of length n: n itself up to EXACT, then rounded up to 1/128 of its power of two."""
    octave = F.floor(F.log2(F.greatest(n - 1, F.lit(1)).cast("double")))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), octave - 7)).cast("long")
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step) * step).cast("long")


def choose_boundaries(edges: np.ndarray, counts: np.ndarray, n_buckets: int, sums: np.ndarray | None = None) -> list[int]:
    """The at most ``n_buckets`` edges, the last included, that minimise the sum of boundary - length.

    ``edges`` are the longest lengths of bins, ``sums`` (edge * count if not given) the sums of their lengths. Fewer buckets are used only where
    that costs nothing; of equal plans the one with the leftmost cuts is taken.
    """
    n = len(edges)
    if n == 0:
        return []
    edges, counts = edges.astype(np.int64), counts.astype(np.int64)
    c = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * edges if sums is None else sums.astype(np.int64))])
    best = edges * c[1:] - s[1:]
    cuts = []
    for _ in range(1, min(n_buckets, n)):
        nxt, cut_at = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + edges[j] * (c[j + 1] - c[1 : j + 1]) - (s[j + 1] - s[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], cut_at[j] = cost[i], i
        cuts.append(cut_at)
        best = nxt
    out, j = [int(edges[-1])], n - 1
    for cut_at in reversed(cuts):
        if (i := int(cut_at[j])) >= 0:
            out.append(int(edges[i]))
            j = i
    return out[::-1]


def pack(lengths: DataFrame, n_buckets: int = 16, budget: int = 16384) -> DataFrame:
    """``(doc_id, n_tokens, bucket, batch, slot)`` for ``lengths(doc_id, n_tokens)``.

    ``bucket`` is the padded length, ``batch`` numbers the batches of a bucket from 0.
    """
    spark = lengths.sparkSession
    x = cut(lengths.select("doc_id", "n_tokens", bin_edge(F.col("n_tokens")).alias("edge")))
    hist = x.groupBy("edge").agg(F.max("n_tokens"), F.count("*"), F.sum("n_tokens")).orderBy("edge").collect()  # bounded: EXACT + 128 bins a power of two
    edges, counts, sums = (np.array([r[i] for r in hist], dtype=np.int64) for i in (1, 2, 3))
    bounds = choose_boundaries(edges, counts, n_buckets, sums)
    totals = [int(counts[(edges <= b) & (edges > lo)].sum()) for lo, b in zip([-1, *bounds[:-1]], bounds)]
    rows = [(b, -(-t // SHARD), max(1, budget // max(b, 1))) for b, t in zip(bounds, totals)]
    plan = spark.createDataFrame(rows or [(0, 1, 1)], "bucket long, shards long, per_batch long")
    first = F.lit(None).cast("long")
    for b in reversed(bounds):
        first = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(first)
    x = x.withColumn("bucket", first).join(F.broadcast(plan), "bucket")  # at most n_buckets rows
    x = x.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), "shards"))
    sizes = x.groupBy("bucket", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    row = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")).cast("long") - 1
    at = F.col("offset") + F.col("row")
    return (
        x.withColumn("row", row)
        .join(offsets, ["bucket", "shard"])
        .select("doc_id", "n_tokens", "bucket", F.floor(at / F.col("per_batch")).alias("batch"), (at % F.col("per_batch")).alias("slot"))
    )


def query(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return pack(d.select("doc_id", n_words(F.col("text")).alias("n_tokens")))
