"""A five-stage corpus pipeline over ``documents``, made of the operators in ``scatterspark.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
one returns a packing row for each. ``run`` writes every stage's result as Parquet into the shared checkpoint folder and
reads it back for the next. Rows with a null or repeated id get keys of their own inside a stage, so that every decision
names one row; in groups of similar documents rows with a single id go before them.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterspark.llm import op3_packing, op6_language, op7_decontaminate, op8_line_dedup, op10_jaccard_join
from scatterspark.llm.common import cut, ensure_checkpoint_dir, scratch, table, without


def _by_row(stage):
    """The stage with a key of its own for each row in place of null and repeated ids, which are put back afterwards."""

    @functools.wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        again = docs.groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1 or __again is null")
        if again.isEmpty():
            return stage(spark, docs, sf_dir)
        again = cut(again.where("__again is not null").select("__again"))
        x = cut(docs.withColumn("__row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
        x = x.join(again, F.col("doc_id") == F.col("__again"), "left").withColumn("__doc_id", F.col("doc_id"))
        fresh = F.xxhash64("doc_id", "__row").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        x = x.withColumn("doc_id", F.when(F.col("doc_id").isNull() | F.col("__again").isNotNull(), fresh).otherwise(F.col("doc_id")))
        out = stage(spark, x.drop("__again", "__row"), sf_dir)
        return out.withColumn("doc_id", F.col("__doc_id")).select(*docs.columns)

    return whole


@_by_row
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or that resemble no learned language, go."""
    return without(docs, op6_language.unlike(docs, op6_language.fit(docs)))


@_by_row
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of similar lines stays; documents left without any words go."""
    with scratch(spark):
        return op8_line_dedup.without_repeats(docs, op8_line_dedup.line_groups(docs))


@_by_row
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays, the one with the smallest id."""
    with scratch(spark):
        found = op10_jaccard_join.join_components(docs)
        return without(docs, found.where(F.col("doc_id") != F.col("component_id")))


@_by_row
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without(docs, op7_decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document."""
    return op3_packing.pack(docs.select("doc_id", op3_packing.n_words(F.col("text")).alias("n_tokens")))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Learned models and connected components can't be stated in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
