"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterspark.session import cut, ensure_checkpoint_dir, forget, saved, scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids(doc_id)``; null ids stay.

    A bit set of 2^23 bits, hashed from the ids, goes to all tasks as 2^17 words. Rows that miss it stay where they are;
    only the others are shuffled for the exact join.
    """
    gone = cut(ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))
    bits = gone.groupBy(F.shiftright(slot("__id"), 6).alias("__word")).agg(F.bit_or(bit(slot("__id"))).alias("__mask"))
    word = F.shiftright(slot("doc_id"), 6)
    x = docs.withColumn("__at", word).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    maybe = F.coalesce(F.col("__mask").bitwiseAND(bit(slot("doc_id"))) != 0, F.lit(False))
    stay = x.where(~maybe).select(*docs.columns)
    return stay.union(x.where(maybe).join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select(*docs.columns))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node reachable.

    Alternating large-star / small-star contraction. Each round only rewrites edges, so no neighbourhood is ever
    gathered in one task: minima come from a grouped ``min`` (combined before the shuffle) and go back by a join that
    adaptive execution can split. Lineage is cut with a checkpoint in every round.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():  # every node hangs on its smallest one alone
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u != v")
            .distinct()
        )
        e = cut(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
