"""Generated point sets, as expressions over ``spark.range``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, lo: list[float], hi: list[float], n: list[int]) -> DataFrame:
    """Regular grid points ``(id, p)``, the first coordinate fastest."""
    total = math.prod(n)
    cols, below = [], 1
    for a, b, k in zip(lo, hi, n):
        i = F.floor(F.col("id") / below) % k
        cols.append(F.lit(float(a)) + i * F.lit((b - a) / max(1, k - 1)))
        below *= k
    return spark.range(total).select("id", F.array(*cols).alias("p"))


PRIMES = [p for p in range(2, 542) if all(p % q for q in range(2, int(p**0.5) + 1))]


def radical_inverse(i: Column, base: int, digits: int) -> Column:
    out, rest, scale = F.lit(0.0), i, 1.0
    for _ in range(digits):
        scale /= base
        out = out + (rest % base) * F.lit(scale)
        rest = F.floor(rest / base)
    return out


def halton(spark: SparkSession, n: int, d: int, skip: int = 0) -> DataFrame:
    """``(id, p)``: n Halton points in d dimensions from index skip + 1 on."""
    i = F.col("id") + 1 + skip
    return spark.range(n).select("id", F.array(*[radical_inverse(i, b, math.ceil(math.log(n + skip + 2, b)) + 1) for b in PRIMES[:d]]).alias("p"))


def normal(spark: SparkSession, n: int, d: int, mean: float = 0.0, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.randn(seed + k) * sigma + mean for k in range(d)]).alias("p"))


def sphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Uniform points of the unit sphere."""
    x = spark.range(n).select("id", *[F.randn(seed + k).alias(f"x{k}") for k in range(3)])
    r = F.sqrt(sum((F.col(f"x{k}") * F.col(f"x{k}") for k in range(3)), F.lit(0.0)))
    return x.select("id", F.array(*[F.col(f"x{k}") / r for k in range(3)]).alias("p"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """Golden-angle lattice on the unit sphere."""
    z = 1 - (2 * F.col("id") + 1) / F.lit(float(n))
    t = F.col("id") * F.lit(math.pi * (3 - math.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return spark.range(n).select("id", F.array(r * F.cos(t), r * F.sin(t), z).alias("p"))


def swiss_roll(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    t = F.lit(1.5 * math.pi) * (1 + 2 * F.rand(seed))
    x = spark.range(n).select("id", t.alias("t"), (21 * F.rand(seed + 1)).alias("v"))
    return x.select("id", F.array(F.col("t") * F.cos("t"), F.col("v"), F.col("t") * F.sin("t")).alias("p"))
