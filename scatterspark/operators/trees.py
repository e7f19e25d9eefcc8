"""Cluster trees of point sets.

A node is named by its heap path: the root is 1, the sons of k are 2k and 2k + 1 (d bits a level in 2^d-ary trees). A
tree is a table of members (id, p, path of the leaf, level); node tables with tight boxes are aggregated from it.

Splitting is distributed: each level finds every node's split row by a histogram of its axis (combined before the
shuffle), so that only the rows of one bin of each node have to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterspark.session import cut

BINS = 256


def dimension(points: DataFrame) -> int:
    first = points.select(F.size("p")).first()
    return first[0] if first else 0


def _axis_value(axis: Column) -> Column:
    return F.element_at("p", axis + 1)


def cluster_tree(points: DataFrame, min_csize: int = 1, max_levels: int = 40, rule: str = "cardinality") -> DataFrame:
    """``(id, p, path, level)``: binary tree along the longest edge of the inherited (cut) box.

    ``cardinality``: the first floor(n / 2) rows by (coordinate, id) go left; nodes of more than 2 min_csize - 1 points
    are split. ``geometric``: points up to the middle of the edge go left.
    """
    d = dimension(points)
    if d == 0:
        return points.select("id", "p", F.lit(1).cast("long").alias("path"), F.lit(0).alias("level"))
    box = points.agg(*[F.min(F.element_at("p", k + 1)).alias(f"lo{k}") for k in range(d)], *[F.max(F.element_at("p", k + 1)).alias(f"hi{k}") for k in range(d)], F.count("*").alias("n")).first()
    done, live = None, points.select("id", "p", F.lit(1).cast("long").alias("path"))
    spark = points.sparkSession
    nodes = spark.createDataFrame([(1, box["n"], [box[f"lo{k}"] for k in range(d)], [box[f"hi{k}"] for k in range(d)])], "path long, n long, lo array<double>, hi array<double>")
    level = 0
    while True:
        big = nodes.where(F.col("n") > 2 * min_csize - 1)
        if level == max_levels or big.isEmpty():
            rest = live.select("id", "p", "path", F.lit(level).alias("level"))
            return cut(rest if done is None else done.union(rest))
        edge = F.zip_with("hi", "lo", lambda h, l: h - l)
        big = big.withColumn("axis", F.array_position(edge, F.array_max(edge)).cast("int") - 1)
        big = cut(big.withColumn("a", F.element_at("lo", F.col("axis") + 1)).withColumn("w", F.element_at("hi", F.col("axis") + 1) - F.col("a")))
        small = live.join(big.select("path"), "path", "left_anti").select("id", "p", "path", F.lit(level).alias("level"))
        done = small if done is None else done.union(small)
        x = live.join(big.select("path", "axis", "a", "w", F.floor(F.col("n") / 2).alias("half")), "path").withColumn("v", _axis_value(F.col("axis")))
        if rule == "geometric":
            x = x.select("id", "p", "path", "axis", "v", (F.col("v") > F.col("a") + F.col("w") / 2).cast("long").alias("right"))
        else:
            bin_ = F.when(F.col("w") > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("a")) / F.col("w") * BINS))).otherwise(0).cast("int")
            x = x.withColumn("bin", bin_)
            hist = x.groupBy("path", "half", "bin").agg(F.count("*").alias("m"))
            below = F.sum("m").over(Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
            hist = hist.withColumn("below", F.coalesce(below, F.lit(0))).where((F.col("below") <= F.col("half")) & (F.col("half") < F.col("below") + F.col("m")))
            pivot = hist.select("path", F.col("bin").alias("pbin"), "below")
            x = x.join(pivot, "path")
            rank = F.row_number().over(Window.partitionBy("path").orderBy("v", "id"))
            inside = x.where("bin = pbin").withColumn("right", (F.col("below") + rank > F.col("half")).cast("long"))
            outside = x.where("bin != pbin").withColumn("right", (F.col("bin") > F.col("pbin")).cast("long"))
            x = inside.unionByName(outside).select("id", "p", "path", "axis", "v", "right")
        x = cut(x.withColumn("son", F.col("path") * 2 + F.col("right")))
        ends = x.groupBy("path", "son", "right").agg(F.count("*").alias("n"), F.min("v").alias("vlo"), F.max("v").alias("vhi"))
        ends = ends.join(big.select("path", "lo", "hi", "axis", (F.col("a") + F.col("w") / 2).alias("middle")), "path")
        left_end = F.col("middle") if rule == "geometric" else F.col("vhi")
        right_start = F.col("middle") if rule == "geometric" else F.col("vlo")
        hi = F.transform("hi", lambda h, i: F.when((i == F.col("axis")) & (F.col("right") == 0), left_end).otherwise(h))
        lo = F.transform("lo", lambda l, i: F.when((i == F.col("axis")) & (F.col("right") == 1), right_start).otherwise(l))
        nodes = cut(ends.select(F.col("son").alias("path"), "n", lo.alias("lo"), hi.alias("hi")))
        live = x.select("id", "p", F.col("son").alias("path"))
        level += 1


def random_projection_tree(points: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """``(id, p, path, level)``: medians of seeded random directions."""
    from scatterspark.operators.neighbours import projection_buckets

    return projection_buckets(points, dimension(points), levels, seed).withColumn("level", F.lit(levels))


def morton_key(p: str, d: int, bits: int, scaled: list[tuple[float, float]] | None = None) -> Column:
    """Interleaved bits of the coordinates, quantised to ``bits`` bits; coordinate 0 has the highest bit of each group."""
    key = F.lit(0).cast("long")
    for k in range(d):
        lo, hi = scaled[k] if scaled else (0.0, 1.0)
        x = (F.element_at(p, k + 1) - lo) / ((hi - lo) or 1.0)
        q = F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(x * (1 << bits)))).cast("long")
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1)), b * d + (d - 1 - k)))
    return key


def unit_kd_tree(points: DataFrame, levels: int) -> DataFrame:
    """``(id, p, path, level)``: cells of a 2^d-ary tree over the unit cube, points outside clamped."""
    d = dimension(points)
    return points.select("id", "p", (morton_key("p", d, levels) + F.lit(1 << (d * levels))).alias("path"), F.lit(levels).alias("level"))


def unit_binary_tree(points: DataFrame, levels: int) -> DataFrame:
    """``(id, p, path, level)``: d * levels midpoint splits, always of the longest axis (lowest first)."""
    d = dimension(points)
    return points.select("id", "p", (morton_key("p", d, levels) + F.lit(1 << (d * levels))).alias("path"), F.lit(d * levels).alias("level"))


def morton_tree(points: DataFrame, levels: int, bits: int = 16) -> DataFrame:
    """``(id, p, path, level)``: points in Morton order, halved ``levels`` times (the first floor(n / 2) left)."""
    d = dimension(points)
    ends = points.agg(*[F.min(F.element_at("p", k + 1)) for k in range(d)], *[F.max(F.element_at("p", k + 1)) for k in range(d)], F.count("*")).first()
    scaled = [(ends[k], ends[d + k]) for k in range(d)]
    n = ends[2 * d]
    x = points.withColumn("key", morton_key("p", d, bits, scaled)).select("id", "p", "key", F.shiftright("key", max(0, d * bits - 12)).alias("part"))
    counts = x.groupBy("part").agg(F.count("*").alias("m"))  # at most 4096 rows
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "id")) - 1
    x = x.withColumn("rank", rank).join(F.broadcast(offsets), "part").select("id", "p", (F.col("before") + F.col("rank")).alias("pos"))
    path, lo, size = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(n).cast("long")
    x = x.withColumns({"path": path, "lo": lo, "size": size})
    for _ in range(levels):
        right = F.col("pos") >= F.col("lo") + F.floor(F.col("size") / 2)
        half = F.floor(F.col("size") / 2)
        x = x.select(
            "id", "p", "pos", (F.col("path") * 2 + right.cast("long")).alias("path"),
            F.when(right, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"),
            F.when(right, F.col("size") - half).otherwise(half).alias("size"),
        )
    return x.select("id", "p", "path", F.lit(levels).alias("level"), "pos")


def nodes(members: DataFrame, d: int, bits: int = 1) -> DataFrame:
    """``(path, level, n, lo, hi)``: every node with its tight box; ``bits`` path bits a level."""
    ancestors = F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.struct(F.expr("0").alias("z"), k.alias("k")))
    x = members.select("p", "path", "level", F.explode(ancestors).alias("a"))
    up = F.floor(F.col("path") / F.pow(F.lit(2.0), (F.col("level") - F.col("a.k")) * bits)).cast("long")
    x = x.select("p", up.alias("path"), F.col("a.k").cast("int").alias("level"))
    lo, hi = [F.min(F.element_at("p", k + 1)).alias(f"lo{k}") for k in range(d)], [F.max(F.element_at("p", k + 1)).alias(f"hi{k}") for k in range(d)]
    g = x.groupBy("path", "level").agg(F.count("*").alias("n"), *lo, *hi)
    return g.select("path", "level", "n", F.array(*[f"lo{k}" for k in range(d)]).alias("lo"), F.array(*[f"hi{k}" for k in range(d)]).alias("hi"))


def numbered(node_table: DataFrame) -> DataFrame:
    """Adds ``block_id``, the position in level order; ranks are taken level by level and shifted by the level counts."""
    counts = node_table.groupBy("level").agg(F.count("*").alias("m"))  # one row a level
    before = F.coalesce(F.sum("m").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("path")) - 1
    x = node_table.withColumn("r", rank).join(F.broadcast(counts.select("level", before.alias("before"))), "level")
    return x.withColumn("block_id", (F.col("before") + F.col("r")).cast("long")).drop("r", "before")


def discrepancy(node_table: DataFrame) -> DataFrame:
    """|n / N - vol / vol(root)| of every node but the root with more than one point."""
    vol = F.aggregate(F.zip_with("hi", "lo", lambda h, l: h - l), F.lit(1.0), lambda s, x: s * x)
    x = node_table.withColumn("vol", vol)
    root = x.where("path = 1").select(F.col("n").alias("rn"), F.col("vol").alias("rv"))
    return x.where("path > 1 and n > 1").crossJoin(F.broadcast(root)).select("path", "level", F.abs(F.col("n") / F.col("rn") - F.col("vol") / F.col("rv")).alias("discrepancy"))  # one row


def histogram(values: DataFrame, column: str, bins: int = 15, drop_max: bool = False, log: bool = False) -> DataFrame:
    """``(bin, n)`` of equal-width (or log-spaced) bins; the last bin is closed unless ``drop_max``."""
    v = F.log(column) if log else F.col(column)
    x = values.where(F.col(column) > 0).select(v.alias("v")) if log else values.select(v.alias("v"))
    ends = x.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    x = x.crossJoin(F.broadcast(ends))  # one row
    h = (F.col("b") - F.col("a")) / bins
    bin_ = F.when(F.col("v") == F.col("b"), F.lit(bins) if drop_max else F.lit(bins - 1)).otherwise(F.floor((F.col("v") - F.col("a")) / h)).cast("int")
    return x.select(bin_.alias("bin")).where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("n"))


def subsample(points: DataFrame, kept: DataFrame, level: int) -> DataFrame:
    """Ids of ``kept`` and, for each grid cell of 2^level a side, the point not kept that is closest to its middle."""
    d = dimension(points)
    side = float(1 << level)
    rest = points.join(kept.select("id"), "id", "left_anti")
    cell = [F.greatest(F.lit(0), F.least(F.lit(int(side) - 1), F.floor(F.element_at("p", k + 1) * side))) for k in range(d)]
    dist = sum(((F.element_at("p", k + 1) - (cell[k] + 0.5) / side) ** 2 for k in range(d)), F.lit(0.0))
    best = rest.groupBy(*[c.alias(f"c{k}") for k, c in enumerate(cell)]).agg(F.min(F.struct(dist.alias("dist"), "id")).alias("best"))
    return kept.select("id").union(best.select("best.id"))
