"""Generators, multi-indices, sparse solvers and hierarchical matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scatterspark.functions import multiindex as mi
from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import hmatrix, neighbours, sparse, trees
from scatterspark.plans.base import r6, register, sq, sql_r6, with_points
from scatterspark.plans.numeric_queries import _flag, _true
from scatterspark.plans.tree_queries import NODES_SQL, _split_sql
from scatterspark.session import cut
from scatterspark.sources import generators, points


def grid(spark, sf_dir):
    return generators.grid(spark, [0.0, -1.0, 2.0], [1.0, 1.0, 3.0], [5, 4, 3]).select("id", *[r6(F.element_at("p", k)).alias(f"x{k}") for k in (1, 2, 3)])


register(
    "grid_points",
    grid,
    f"select i as id, {sql_r6('(i % 5) / 4.0::double')} as x1, {sql_r6('-1 + 2 * ((i // 5) % 4) / 3.0::double')} as x2, {sql_r6('2 + (i // 20) / 2.0::double')} as x3 from range(60) t(i)",
)


def _radical(base, digits=10):
    return " + ".join(f"((i // {base**k}) % {base}) / {float(base ** (k + 1))}::double" for k in range(digits))


def halton(spark, sf_dir):
    return generators.halton(spark, 500, 3).select("id", *[r6(F.element_at("p", k)).alias(f"x{k}") for k in (1, 2, 3)])


register("halton_points", halton, "select i - 1 as id, " + ", ".join(f"{sql_r6(_radical(b))} as x{k + 1}" for k, b in enumerate((2, 3, 5))) + " from range(1, 501) t(i)")


def generated_invariants(spark, sf_dir):
    ok = []
    for x in (generators.sphere(spark, 200), generators.fibonacci(spark, 200)):
        r = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, v: s + v * v))
        ok.append(x.agg(F.max(F.abs(r - 1))).first()[0] < 1e-12)
    n = generators.normal(spark, 20000, 1, 2.0, 3.0).agg(F.avg(F.element_at("p", 1)), F.stddev(F.element_at("p", 1))).first()
    roll = generators.swiss_roll(spark, 200).agg(F.min(F.element_at("p", 2)), F.max(F.element_at("p", 2))).first()
    return _flag(spark, *ok, abs(n[0] - 2) < 0.1 and abs(n[1] - 3) < 0.1, 0 <= roll[0] and roll[1] <= 21)


register("generated_points", generated_invariants, _true(4))

_ABC = "range(0, 12) a(a), range(0, 12) b(b), range(0, 12) c(c)"
_SET = {"total_degree": (lambda: mi.total_degree(3, 4), "a + b + c <= 4"), "tensor_product": (lambda: mi.tensor_product(3, 2), "a <= 2 and b <= 2 and c <= 2"), "weighted_degree": (lambda: mi.total_degree(3, 7, [1.0, 2.0, 3.0]), "a + 2*b + 3*c <= 7")}
for _name, (_make, _where) in _SET.items():
    register(
        f"multi_index_{_name}",
        lambda spark, sf_dir, make=_make: mi.frame(spark, make()).select("pos", *[F.element_at("alpha", k).cast("long").alias(x) for k, x in enumerate("abc", 1)]),
        f"select row_number() over (order by a + b + c, a, b, c) - 1 as pos, a, b, c from {_ABC} where {_where}",
    )
    register(
        f"combination_{_name}",
        lambda spark, sf_dir, make=_make: spark.createDataFrame([(*a, w) for a, w in mi.combination(make())], "a long, b long, c long, w long"),
        f"with s as (select a, b, c from {_ABC} where {_where}) select s.a, s.b, s.c, sum(case when (t.a+t.b+t.c-s.a-s.b-s.c) % 2 = 0 then 1 else -1 end)::bigint as w"
        " from s join s t on t.a - s.a in (0, 1) and t.b - s.b in (0, 1) and t.c - s.c in (0, 1) group by 1, 2, 3 having sum(case when (t.a+t.b+t.c-s.a-s.b-s.c) % 2 = 0 then 1 else -1 end) <> 0",
    )

NDS = [2, 4, 3, 5]


def mixed_radix(spark, sf_dir):
    x = spark.range(120).withColumn("alpha", mi.to_multi(F.col("id"), NDS))
    return x.select("id", mi.to_scalar(F.col("alpha"), NDS).alias("back"), *[F.element_at("alpha", k + 1).cast("long").alias(f"a{k}") for k in range(4)])


register("mixed_radix", mixed_radix, "select i as id, i as back, i % 2 as a0, (i // 2) % 4 as a1, (i // 8) % 3 as a2, i // 24 as a3 from range(120) t(i)")
register(
    "binomials",
    lambda spark, sf_dir: spark.createDataFrame([(n, k, mi.binomial(n, k), mi.multinomial([n, k], [k, k])) for n in range(13) for k in range(n + 1)], "n long, k long, c long, m long"),
    "select n, k, (factorial(n::int) // (factorial(k::int) * factorial((n - k)::int)))::bigint as c, (factorial(n::int) // (factorial(k::int) * factorial((n - k)::int)))::bigint as m from range(13) a(n), range(13) b(k) where k <= n",
)
register(
    "soft_shrinkage",
    lambda spark, sf_dir: points.part2(spark, sf_dir).select("id", r6(sparse.soft_shrinkage(F.element_at("p", 2) - 0.5, 0.2)).alias("s"), (F.abs(F.element_at("p", 2) - 0.5) > 0.2).alias("active")),
    with_points("part2", f"select id, {sql_r6('sign(p[2] - 0.5::double) * greatest(abs(p[2] - 0.5::double) - 0.2::double, 0)')} as s, abs(p[2] - 0.5::double) > 0.2::double as active from p"),
)


def kernel_column(spark, sf_dir):
    """One kernel column in cluster order."""
    x = trees.morton_tree(points.part2(spark, sf_dir), 3)
    c = x.where("id = 7").select(F.col("p").alias("q"))
    return x.crossJoin(F.broadcast(c)).select("pos", "id", r6(CovarianceKernel("exponential", 0.5)(F.col("p"), F.col("q"))).alias("k"))  # one row


from scatterspark.plans.tree_queries import MORTON_SQL  # noqa: E402

register("kernel_column", kernel_column, with_points("part2", f"select a.pos, a.id, {sql_r6(f'exp(-sqrt({sq('a.p', 'b.p', 2)}) / 0.5::double)')} as k from o a, o b where b.id = 7", *MORTON_SQL))


def footprints(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    n = neighbours.eps_counts(x, 0.03, 2)
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


register("footprints", footprints, with_points("part2", f"select min(n) as least, max(n) as most, {sql_r6('avg(n)')} as mean from (select a.id, count(*) as n from p a, p b where sqrt({sq('a.p', 'b.p', 2)}) < 0.03::double group by a.id)"))


def local_inverse_rows(spark, sf_dir):
    """K_NN times each local row is the unit vector: row sums of v k(i, j) are 1. Points at one place are summed at once."""
    x = points.part2(spark, sf_dir)
    k = CovarianceKernel("exponential", 0.5)
    v, at = sparse.local_inverse_of_places(x, k, 0.03, 2, 0.1)
    p = cut(x.select("id", "p").join(at.hint("merge"), "id").groupBy("place").agg(F.first("p").alias("p")))
    e = v.join(p.select(F.col("place").alias("a"), F.col("p").alias("pa")).hint("merge"), "a").join(p.select(F.col("place").alias("b"), F.col("p").alias("pb")).hint("merge"), "b")
    kab, own = k(F.col("pa"), F.col("pb")), F.when(F.col("a") == F.col("b"), 0.1 * (F.col("v") + F.col("own"))).otherwise(0.0)
    s = e.groupBy("a").agg(F.sum((F.col("m") * F.col("v") + F.col("own")) * kab + own).alias("s"))
    return at.join(s.select(F.col("a").alias("place"), "s").hint("merge"), "place").select(F.col("id").alias("i"), r6(F.col("s")).alias("s"))


register("local_inverse", local_inverse_rows, "select p_partkey as i, 1.0::double as s from part")


def local_root_rows(spark, sf_dir):
    """Rows of local inverse square roots: all entries of neighbourhoods of one or two points, the squared length of others."""
    v, at = sparse.local_inverse_of_places(points.part2(spark, sf_dir), CovarianceKernel("exponential", 0.5), 0.0101, 2, 0.1, root=True)
    own = F.sum(F.when(F.col("a") == F.col("b"), F.col("v") + F.col("own")).otherwise(0.0))
    s = v.groupBy(F.col("a").alias("place")).agg(F.sum("m").alias("n"), own.alias("own"), (F.sum(F.col("m") * F.col("v") + F.col("own")) - own).alias("other"))
    s = s.select("place", "n", F.when(F.col("n") <= 2, r6(F.col("own"))).alias("own"), F.when(F.col("n") <= 2, r6(F.col("other"))).alias("other"))
    return at.join(s.hint("merge"), "place").select(F.col("id").alias("i"), "n", "own", "other")


register(
    "local_inverse_root",
    local_root_rows,
    with_points(
        "part2",
        f"""select i, n, case when n = 1 then {sql_r6('1 / sqrt(1.1::double)')} when n = 2 then {sql_r6('(1 / sqrt(1.1 + k) + 1 / sqrt(1.1 - k)) / 2')} end as own,
        case when n = 1 then 0.0::double when n = 2 then {sql_r6('(1 / sqrt(1.1 + k) - 1 / sqrt(1.1 - k)) / 2')} end as other from w""",
        f"w as (select a.id as i, count(*) as n, sum(case when a.id = b.id then 0 else exp(-sqrt({sq('a.p', 'b.p', 2)}) / 0.5::double) end) as k from p a, p b where sqrt({sq('a.p', 'b.p', 2)}) < 0.0101::double group by a.id)",
    ),
)


def solver_invariants(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    e = neighbours.sym_eps_nn(x, 0.03, 2).select("i", "j", (-F.exp(-F.col("dist") * 50)).alias("v"))
    d = x.select(F.col("id").alias("i")).join(e.groupBy("i").agg((-F.sum("v")).alias("s")), "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + 0.5).alias("v"))
    a = e.union(d).cache()
    b = x.select(F.col("id").alias("i"), F.col("f").alias("b"))
    sol, history = sparse.conjugate_gradients(a, b, 0.0, 1e-8, 60)
    r = sparse.multiply(a, sol.select(F.col("i").alias("j"), "x")).join(b, "i").agg(F.max(F.abs(F.col("y") - F.col("b")))).first()[0]
    top = sparse.power_iteration(a, x.select(F.col("id").alias("j"), F.lit(1.0).alias("x")), 5)
    rng = np.random.default_rng(0)
    m, w = rng.normal(size=(40, 60)), np.full(60, 3.0)
    y = rng.normal(size=40) * 5
    z = sparse.semismooth_newton(m, y, w, 5000)
    g = m.T @ (m @ z - y)
    kkt = np.abs(g[z != 0] + w[z != 0] * np.sign(z[z != 0])).max() < 1e-6 and (np.abs(g[z == 0]) <= w[z == 0] + 1e-6).all()
    return _flag(spark, history[-1] < 1e-8, r < 1e-3, top >= 0.4, kkt)


register("sparse_solvers", solver_invariants, _true(4))

LEVELS, LEAST, ETA = 4, 40, 0.8


def _nodes(spark, sf_dir):
    m = trees.cluster_tree(points.part2(spark, sf_dir), LEAST, LEVELS)
    n = trees.nodes(m, 2)
    fathers = n.where("path > 1").select(F.floor(F.col("path") / 2).cast("long").alias("path")).distinct().withColumn("inner", F.lit(True))
    return m, n.join(fathers, "path", "left").select("path", "n", "lo", "hi", F.col("inner").isNull().alias("leaf"))


def block_counts(spark, sf_dir):
    return hmatrix.statistics(hmatrix.block_pattern(_nodes(spark, sf_dir)[1], ETA)).select("kind", "blocks", "entries")


def _fronts():
    out = ["nd as (select path, n, lx, hx, ly, hy, path not in (select path // 2 from nodes) as leaf from nodes)", "f0 as (select 1::bigint as a, 1::bigint as b)"]
    for k in range(LEVELS + 1):
        ra, rb = ("sqrt(power({0}.hx-{0}.lx,2)+power({0}.hy-{0}.ly,2))/2".format(s) for s in ("x", "y"))
        d = "sqrt(power((x.lx+x.hx)/2-(y.lx+y.hx)/2,2)+power((x.ly+x.hy)/2-(y.ly+y.hy)/2,2))"
        out.append(
            f"k{k} as (select a, b, x.n as na, y.n as nb, case when greatest({ra}, {rb}) <= {ETA}::double * greatest(0, {d} - {ra} - {rb}) then 'low_rank' when x.leaf or y.leaf then 'dense' else 'refine' end as kind from f{k} join nd x on x.path = a join nd y on y.path = b)"
        )
        out.append(f"f{k + 1} as (select a * 2 + s as a, b * 2 + t as b from k{k}, range(2) u(s), range(2) v(t) where kind = 'refine')")
    return tuple(out)


register(
    "block_pattern",
    block_counts,
    with_points(
        "part2",
        "select kind, count(*) as blocks, sum(na * nb)::bigint as entries from (" + " union all ".join(f"select * from k{k}" for k in range(LEVELS + 1)) + ") where kind <> 'refine' group by kind",
        *_split_sql(LEVELS, LEAST),
        *[s.format(l=LEVELS) for s in NODES_SQL],
        *_fronts(),
    ),
)


def block_product(spark, sf_dir):
    """K times a vector by blocks, to five digits relative to its size; the SQL side sums the dense product."""
    m, n = _nodes(spark, sf_dir)
    x = points.part2(spark, sf_dir).select("id", (F.col("f") / 1000).alias("x"))
    y = hmatrix.multiply(m, hmatrix.block_pattern(n, ETA), CovarianceKernel("exponential", 1.0), x, 1e-10)
    return y.select("id", F.round("y", 3).alias("y"))


register("block_product", block_product, with_points("part2", f"select a.id, round(sum(exp(-sqrt({sq('a.p', 'b.p', 2)})) * b.f / 1000), 3) as y from p a, p b group by a.id"))
