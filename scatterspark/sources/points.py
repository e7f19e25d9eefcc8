"""Point sets over the driver's tables; every one is ``(id long, p array<double>, f double)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-dimensional points."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p"), F.col("label").cast("double").alias("f"))


def sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three coordinates of the embeddings, scaled to the unit sphere."""
    x = [F.element_at("p", i) for i in (1, 2, 3)]
    norm = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return e64(spark, sf_dir).select("id", F.array(*[c / norm for c in x]).alias("p"), "f")


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size and price in the unit square."""
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / F.lit(50.0), (F.col("p_retailprice") - 900) / 100).alias("p"), F.col("p_retailprice").alias("f"))


def _days(ts: Column) -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz")).cast("double") / F.lit(1e6) / F.lit(2592000.0)


def ev1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by time in a month of 30 days."""
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_id").alias("id"), F.array(_days(F.col("ts"))).alias("p"), F.col("value").alias("f"))


def ev2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by time and value."""
    t = table(spark, sf_dir, "events")
    return t.select(F.col("event_id").alias("id"), F.array(_days(F.col("ts")), F.col("value") / F.lit(500.0)).alias("p"), F.col("value").alias("f"))


def cb1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance."""
    t = table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("id"), F.array((F.col("c_acctbal") + 1000) / F.lit(11000.0)).alias("p"), F.col("c_acctbal").alias("f"))


#: The same point sets in SQL.
SQL = {
    "e64": "select vec_id as id, embedding::double[] as p, label::double as f from embeddings",
    "sphere": """select id, list_transform(p[1:3], lambda x: x / sqrt(p[1]*p[1] + p[2]*p[2] + p[3]*p[3])) as p, f
                 from (select vec_id as id, embedding::double[] as p, label::double as f from embeddings)""",
    "part2": "select p_partkey as id, [p_size / 50.0::double, (p_retailprice - 900) / 100] as p, p_retailprice as f from part",
    "ev1": "select event_id as id, [date_diff('microsecond', timestamp '2024-01-01', ts)::double / 1e6 / 2592000.0::double] as p, value as f from events",
    "ev2": "select event_id as id, [date_diff('microsecond', timestamp '2024-01-01', ts)::double / 1e6 / 2592000.0::double, value / 500.0::double] as p, value as f from events",
    "cb1": "select c_custkey as id, [(c_acctbal + 1000) / 11000.0::double] as p, c_acctbal as f from customer",
}
