"""Nearest-neighbour and radius joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterspark.operators import neighbours
from scatterspark.plans.base import r6, register, sq, sql_r6, with_points
from scatterspark.sources import points

_DIST = "d as (select a.id as i, b.id as j, sqrt({}) as dist from p a join p b on a.id <> b.id)"
_RANK = "r as (select i, j, dist, row_number() over (partition by i order by dist, j) as rank from d)"


def _knn_sql(name, dim, k, body):
    return with_points(name, body.format(k=k), _DIST.format(sq("a.p", "b.p", dim)), _RANK)


_ALL = f"select i, rank::int as rank, j, {sql_r6('dist')} as dist from r where rank <= {{k}}"
_HALF = "h as (select i, j, dist from r where rank <= {k} and j < i)"


def _knn(name, dim, k):
    def query(spark, sf_dir):
        return neighbours.knn(getattr(points, name)(spark, sf_dir), k).withColumn("dist", r6(F.col("dist")))

    return query, _knn_sql(name, dim, k, _ALL)


register("knn_e64", *_knn("e64", 64, 5))
register("knn_part2", *_knn("part2", 2, 4))
register("knn_cb1", *_knn("cb1", 1, 3))


def sym_knn(rule):
    def query(spark, sf_dir):
        return neighbours.sym_knn(points.part2(spark, sf_dir), 5, rule).withColumn("dist", r6(F.col("dist")))

    keep = {"larger": "select i, j, dist from r where rank <= 5 and j < i",
            "union": "select greatest(i, j) as i, least(i, j) as j, min(dist) as dist from r where rank <= 5 group by 1, 2",
            "mutual": "select greatest(i, j) as i, least(i, j) as j, min(dist) as dist from r where rank <= 5 group by 1, 2 having count(*) = 2"}[rule]
    sql = with_points("part2", f"select i, j, {sql_r6('dist')} as dist from h union all select j, i, {sql_r6('dist')} from h", _DIST.format(sq("a.p", "b.p", 2)), _RANK, f"h as ({keep})")
    return query, sql


for _rule in ("larger", "union", "mutual"):
    register(f"sym_knn_{_rule}", *sym_knn(_rule))

EPS = 0.06


def eps_nn(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    q = x.where("id % 50 = 0").select("id", "p")
    return neighbours.eps_nn(x, q, EPS, 2).withColumn("dist", r6(F.col("dist")))


register(
    "eps_nn_part2",
    eps_nn,
    with_points("part2", f"select a.id as q, b.id as j, {sql_r6(f'sqrt({sq('a.p', 'b.p', 2)})')} as dist from p a, p b where a.id % 50 = 0 and sqrt({sq('a.p', 'b.p', 2)}) < {EPS}::double"),
)


def sym_eps_nn(spark, sf_dir):
    return neighbours.sym_eps_nn(points.part2(spark, sf_dir), 0.02, 2).withColumn("dist", r6(F.col("dist")))


register(
    "sym_eps_nn_part2",
    sym_eps_nn,
    with_points("part2", f"select a.id as i, b.id as j, {sql_r6(f'sqrt({sq('a.p', 'b.p', 2)})')} as dist from p a, p b where a.id <> b.id and sqrt({sq('a.p', 'b.p', 2)}) < 0.02::double"),
)


def eps_nn_e64(spark, sf_dir):
    return neighbours.sym_eps_nn(points.e64(spark, sf_dir), 1.05, 64).select("i", "j", r6(F.col("dist")).alias("dist"))


register("sym_eps_nn_e64", eps_nn_e64, with_points("e64", f"select i, j, {sql_r6('dist')} as dist from d where dist < 1.05::double", _DIST.format(sq("a.p", "b.p", 64))))


def min_distance(spark, sf_dir):
    return neighbours.min_distance(points.part2(spark, sf_dir)).select("id", r6(F.col("dist")).alias("dist"))


register("min_distance_part2", min_distance, with_points("part2", f"select i as id, {sql_r6('min(dist)')} as dist from d group by i", _DIST.format(sq("a.p", "b.p", 2))))


def duplicates(spark, sf_dir):
    """Groups of coinciding points."""
    return points.part2(spark, sf_dir).groupBy("p").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("first", "n")


register("duplicate_points", duplicates, with_points("part2", "select min(id) as first, count(*) as n from p group by p having count(*) > 1"))


def fast_min_distance_bound(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    fast = neighbours.fast_min_distance(x, 2, 4, 100).withColumnRenamed("dist", "fast")
    both = neighbours.min_distance(x).join(fast, "id")
    return both.select("id", (F.col("fast") >= F.col("dist") - 1e-12).alias("is_upper_bound"))


register("fast_min_distance_bound", fast_min_distance_bound, "select p_partkey as id, true as is_upper_bound from part")


def approximate_recall(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    exact, near = neighbours.sym_knn(x, 5), neighbours.approximate_sym_knn(x, 2, 5, 100, 4)
    hit = exact.join(near, ["i", "j"], "left_semi").count()
    return spark.createDataFrame([(hit / exact.count() > 0.9,)], "recall_above_90 boolean")


register("approximate_knn_recall", approximate_recall, "select true as recall_above_90")


def complement(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    return x.select("id").join(x.where("id % 3 = 0").select("id"), "id", "left_anti")


register("id_complement", complement, "select p_partkey as id from part where p_partkey % 3 <> 0")
