"""Queries on polynomials, spherical harmonics, interpolation and H2 matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scatterspark.functions import harmonics, polynomials
from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import hmatrix, interpolation, trees
from scatterspark.plans.base import r6, register, sql_r6, sq, with_points
from scatterspark.session import cut
from scatterspark.sources import points


def _gauss(spark, sf_dir):
    """Nodes and weights for 4 and 5, and the moments that the rule for 10 gives."""
    rows = [(n, k, float(x), float(w)) for n in (4, 5) for k, (x, w) in enumerate(zip(*polynomials.gauss_legendre(n)))]
    x, w = polynomials.gauss_legendre(10)
    rows += [(10, k, float(k), float(w @ x**k)) for k in range(20)]
    return spark.createDataFrame(rows, "n int, k int, x double, w double").select("n", "k", r6(F.col("x")).alias("x"), r6(F.col("w")).alias("w"))


register(
    "gauss_legendre_rules",
    _gauss,
    f"""with a as (select sqrt(3/7.0::double - 2/7.0::double * sqrt(1.2::double)) as s, sqrt(3/7.0::double + 2/7.0::double * sqrt(1.2::double)) as t, (18 + sqrt(30::double)) / 36 as u, (18 - sqrt(30::double)) / 36 as v),
b as (select sqrt(5 - 2 * sqrt(10 / 7.0::double)) / 3 as s, sqrt(5 + 2 * sqrt(10 / 7.0::double)) / 3 as t, (322 + 13 * sqrt(70::double)) / 900 as u, (322 - 13 * sqrt(70::double)) / 900 as v),
r as (select 4 as n, unnest([0, 1, 2, 3]) as k, unnest([-t, -s, s, t]) as x, unnest([v, u, u, v]) as w from a
      union all select 5, unnest([0, 1, 2, 3, 4]), unnest([-t, -s, 0, s, t]), unnest([v, u, 128 / 225.0::double, u, v]) from b)
select n, k, {sql_r6("(x + 1) / 2")} as x, {sql_r6("w / 2")} as w from r
union all select 10, k::int, k::double, {sql_r6("1 / (k + 1.0::double)")} from range(20) t(k)""",
)


def _leja(spark, sf_dir):
    """The distance product of each of 12 Leja points to those before it, and how far any of 10,001 grid points exceeds it."""
    x = polynomials.leja_points(12)
    own = spark.createDataFrame([(k, float(v), [float(t) for t in x[:k]]) for k, v in enumerate(x) if k > 1], "k int, x double, before array<double>")
    product = lambda t: F.aggregate("before", F.lit(1.0), lambda a, b: a * F.abs(t - b))
    grid = F.explode(F.sequence(F.lit(0), F.lit(10_000))).alias("g")
    far = own.select("k", product(F.col("x")).alias("own"), "before", grid).select("k", "own", product(F.col("g") / 10_000).alias("p"))
    return far.groupBy("k").agg((F.max("p") <= F.max("own") * (1 + 1e-9)).alias("largest"))


register("leja_points", _leja, "select k::int as k, true as largest from range(2, 12) t(k)")


def _legendre(spark, sf_dir):
    """Orthonormal Legendre polynomials up to degree 4 at every customer's balance."""

    def fn(frames):
        for f in frames:
            f["y"] = list(polynomials.legendre(f["x"].to_numpy(), 4))
            yield f[["id", "y"]]

    y = points.cb1(spark, sf_dir).select("id", F.element_at("p", 1).alias("x")).mapInPandas(fn, "id long, y array<double>")
    return y.select("id", *[r6(F.element_at("y", k + 1)).alias(f"y{k}") for k in range(5)])


register(
    "legendre_polynomials",
    _legendre,
    with_points(
        "cb1",
        "select id, " + ", ".join(f"{sql_r6(f'sqrt({2 * k + 1}::double) * ({e})')} as y{k}" for k, e in enumerate(["1::double", "t", "(3*t*t - 1) / 2", "(5*t*t*t - 3*t) / 2", "(35*t*t*t*t - 30*t*t + 3) / 8"])) + " from (select id, 2 * p[1] - 1 as t from p)",
    ),
)


def _interpolated(spark, sf_dir):
    """sin(5 x) at every customer's balance by barycentric interpolation at 6 Chebyshev nodes."""
    nodes = polynomials.chebyshev_nodes(6)

    def fn(frames):
        for f in frames:
            f["y"] = polynomials.lagrange(f["x"].to_numpy(), nodes) @ np.sin(5 * nodes)
            yield f[["id", "y"]]

    y = points.cb1(spark, sf_dir).select("id", F.element_at("p", 1).alias("x")).mapInPandas(fn, "id long, y double")
    return y.select("id", r6(F.col("y")).alias("y"))


register(
    "barycentric_interpolation",
    _interpolated,
    with_points(
        "cb1",
        f"select id, {sql_r6('sum(sin(5 * x) * l)')} as y from l group by id",
        "c as (select k, (1 - cos((2 * k + 1) * pi() / 12)) / 2 as x from range(6) t(k))",
        "l as (select p.id, a.k, a.x, product((p.p[1] - b.x) / (a.x - b.x)) as l from p, c a, c b where a.k <> b.k group by p.id, a.k, a.x)",
    ),
)


def _harmonics(spark, sf_dir):
    y = harmonics.evaluate(points.sphere(spark, sf_dir), 2)
    return y.select("id", *[r6(F.element_at("y", k + 1)).alias(f"y{k}") for k in range(9)])


_Y = [
    "0.5 * sqrt(1 / pi())", "sqrt(3 / (4 * pi())) * y", "sqrt(3 / (4 * pi())) * z", "sqrt(3 / (4 * pi())) * x",
    "0.5 * sqrt(15 / pi()) * x * y", "0.5 * sqrt(15 / pi()) * y * z", "0.25 * sqrt(5 / pi()) * (3 * z * z - 1)",
    "0.5 * sqrt(15 / pi()) * x * z", "0.25 * sqrt(15 / pi()) * (x * x - y * y)",
]
register(
    "spherical_harmonics",
    _harmonics,
    with_points("sphere", "select id, " + ", ".join(f"{sql_r6(e)} as y{k}" for k, e in enumerate(_Y)) + " from (select id, p[1] as x, p[2] as y, p[3] as z from p)"),
)


def _field(spark, sf_dir):
    """A field on the sphere synthesised from given coefficients of its harmonics."""
    y = harmonics.evaluate(points.sphere(spark, sf_dir), 2)
    c = F.array(*[F.lit(1.0 / (k + 1)) for k in range(9)])
    return y.select("id", r6(F.aggregate(F.zip_with("y", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("f"))


register(
    "harmonic_synthesis",
    _field,
    with_points("sphere", f"select id, {sql_r6(' + '.join(f'({e}) / {k + 1}' for k, e in enumerate(_Y)))} as f from (select id, p[1] as x, p[2] as y, p[3] as z from p)"),
)


_KERNEL = CovarianceKernel("gaussian", 1.0)
ETA, DEGREE, LEAF_LEVELS = 0.8, 9, 5


def _tree(spark, sf_dir):
    members = cut(trees.morton_tree(points.part2(spark, sf_dir), LEAF_LEVELS).select("id", "p", "path", "level"))
    return members, cut(trees.nodes(members, 2).withColumn("leaf", F.col("level") == LEAF_LEVELS))


def _h2(spark, sf_dir):
    members, nodes = _tree(spark, sf_dir)
    return members, nodes, hmatrix.block_pattern(nodes, ETA)


def _h2_product(spark, sf_dir):
    """K f of the parts' prices: a Gaussian kernel through nested bases of degree 9."""
    members, nodes, pattern = _h2(spark, sf_dir)
    x = points.part2(spark, sf_dir).select("id", (F.col("f") / 1e4).alias("x"))
    y = interpolation.multiply(members, nodes, pattern, _KERNEL, interpolation.TensorInterpolator(2, DEGREE), x)
    return y.select("id", F.round("y", 4).alias("y"))


register(
    "h2_product",
    _h2_product,
    with_points("part2", f"select a.id, round(sum(exp(-{sq('a.p', 'b.p', 2)} / 2) * b.f / 1e4::double), 4) as y from p a, p b group by a.id"),
)


def _transfers(spark, sf_dir):
    """Largest difference of a father's Lagrange functions at all points from what the sons' give, in powers of ten."""
    members, nodes = _tree(spark, sf_dir)
    rows = []
    for name, i in (("tensor", interpolation.TensorInterpolator(2, 4)), ("monomial", interpolation.monomial_interpolator(2, 4)), ("legendre", interpolation.total_degree_interpolator(2, 4)), ("weighted", interpolation.total_degree_interpolator(2, 4, [1.0, 2.0]))):
        up = F.floor(F.col("path") / 2).cast("long")
        box = nodes.select(F.col("path").alias("k"), "lo", "hi")
        x = members.select("p", "path", up.alias("f")).join(box.withColumnRenamed("k", "path"), "path")
        x = x.join(box.select(F.col("k").alias("f"), F.col("lo").alias("flo"), F.col("hi").alias("fhi")), "f")

        def fn(frames, i=i):
            for f in frames:
                worst = 0.0
                for _, g in f.groupby("path"):
                    son, father = [(np.array(g[a].iloc[0]), np.array(g[b].iloc[0])) for a, b in (("lo", "hi"), ("flo", "fhi"))]
                    p = np.array(g["p"].tolist())
                    worst = max(worst, np.abs(i.on_box(p, *son) @ interpolation.transfer(i, son, father) - i.on_box(p, *father)).max())
                yield f.iloc[:1].assign(worst=worst)[["worst"]]

        rows.append(x.mapInPandas(fn, "worst double").agg(F.lit(name).alias("basis"), (F.max("worst") < 1e-10).alias("nested")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


register("h2_transfer_matrices", _transfers, "select unnest(['tensor', 'monomial', 'legendre', 'weighted']) as basis, true as nested")


def _h2_statistics(spark, sf_dir):
    """Numbers stored by the H2 matrix, against the block pattern."""
    _, _, pattern = _h2(spark, sf_dir)
    rank = (DEGREE + 1) ** 2
    s = interpolation.statistics(interpolation.block_kinds(pattern, rank), rank)
    n = points.part2(spark, sf_dir).agg(F.count("*").alias("n"))
    return s.crossJoin(F.broadcast(n)).select(r6(F.col("per_row") * F.col("n") / F.col("entries")).alias("rows"), (F.col("entries") <= F.col("n") * F.col("n")).alias("less"))  # one row each


register("h2_statistics", _h2_statistics, with_points("part2", "select 1.0::double as rows, true as less"))
