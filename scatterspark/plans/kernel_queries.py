"""Kernel evaluations against a few fixed centres, distances, and box predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterspark.functions import geometry
from scatterspark.functions.distances import dot, euclidean, geodesic
from scatterspark.functions.kernels import CovarianceKernel, space_time_periodic
from scatterspark.plans.base import r6, register, sq, sql_r6, with_points
from scatterspark.sources import points

CENTRES = ((0.25, 0.25), (0.5, 0.5), (0.75, 0.505))
POLES = ((1.0, 0.0, 0.0), (0.0, 0.6, 0.8), (-0.48, 0.6, 0.64))
L, C = 0.4, 0.7
POLE_SQL = "b as (select * from (values " + ", ".join(f"({i}::bigint, {list(q)}::double[])" for i, q in enumerate(POLES)) + ") t(id, p))"

S3, S5, S7, S9 = (f"(sqrt({n}::double) * r / {L}::double)" for n in (3, 5, 7, 9))
KERNEL_SQL = {
    "BIHARMONIC2D": f"case when r < 2.220446049250313e-16 then 0.0::double else (r/{L}::double)*(r/{L}::double)*ln(r/{L}::double) end",
    "BIHARMONIC3D": f"r/{L}::double",
    "TRIHARMONIC3D": f"power(r/{L}::double, 3)",
    "EXPONENTIAL": f"exp(-r/{L}::double)",
    "MATERN32": f"(1 + {S3}) * exp(-{S3})",
    "MATERN52": f"(1 + {S5} + {S5}*{S5}/3) * exp(-{S5})",
    "MATERN72": f"(1 + {S7} + 2*{S7}*{S7}/5 + power({S7},3)/15) * exp(-{S7})",
    "MATERN92": f"(1 + {S9} + 3*{S9}*{S9}/7 + 2*power({S9},3)/21 + power({S9},4)/105) * exp(-{S9})",
    "GAUSSIAN": f"exp(-r*r/(2*{L}::double*{L}::double))",
    "MATERNNU": f"(1 + {S3}) * exp(-{S3})",
    "INVMULTIQUADRIC": f"1/sqrt((r/{L}::double)*(r/{L}::double) + {C}::double*{C}::double)",
    "MULTIQUADRIC": f"sqrt((r/{L}::double)*(r/{L}::double) + {C}::double*{C}::double)",
    "TPS2D": "case when r < 2.220446049250313e-16 then 0.0::double else r*r*ln(r) end",
}


def _centres(spark):
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(CENTRES)], "c long, q array<double>")


CENTRE_SQL = "c as (select * from (values " + ", ".join(f"({i}::bigint, [{a}::double, {b}::double])" for i, (a, b) in enumerate(CENTRES)) + ") t(c, q))"


def _kernel(name):
    def query(spark, sf_dir):
        k = CovarianceKernel(name.lower(), L, C, 1.5)
        pairs = points.part2(spark, sf_dir).crossJoin(F.broadcast(_centres(spark)))  # three fixed centres
        return pairs.select("id", "c", r6(k(F.col("p"), F.col("q"))).alias("k"))

    body = f"select id, c, {sql_r6(KERNEL_SQL[name])} as k from (select id, c, sqrt({sq('p', 'q', 2)}) as r from p, c)"
    register(f"kernel_{name.lower()}", query, with_points("part2", body, CENTRE_SQL))


for _name in KERNEL_SQL:
    _kernel(_name)


def geodesic_kernel(spark, sf_dir):
    x = points.sphere(spark, sf_dir).select("id", "p")
    y = spark.createDataFrame(list(enumerate(map(list, POLES))), "c long, q array<double>")
    k = CovarianceKernel("exponential", 1.0, metric="geodesic")
    return x.crossJoin(F.broadcast(y)).select("id", "c", F.round(geodesic(F.col("p"), F.col("q")), 5).alias("r"), F.round(k(F.col("p"), F.col("q")), 5).alias("k"))


register(
    "kernel_geodesic",
    geodesic_kernel,
    with_points(
        "sphere",
        "select id, c, round(r, 5) as r, round(exp(-r), 5) as k from (select a.id, b.id as c, acos(greatest(-1::double, least(1::double, a.p[1]*b.p[1] + a.p[2]*b.p[2] + a.p[3]*b.p[3]))) as r from p a, b)",
        POLE_SQL,
    ),
)


def space_time(spark, sf_dir):
    x = points.sphere(spark, sf_dir).select("id", "p")
    y = spark.createDataFrame(list(enumerate(map(list, POLES))), "c long, q array<double>")
    return x.crossJoin(F.broadcast(y)).select("id", "c", r6(space_time_periodic(F.col("p"), F.col("q"), L, C)).alias("k"))


register(
    "kernel_space_time_periodic",
    space_time,
    with_points(
        "sphere",
        f"select id, c, {sql_r6(f'(1 + {S3}) * exp(-{S3}) * exp(-2 * sin(pi() * t) * sin(pi() * t) / ({C}::double * {C}::double))')} as k from (select a.id, b.id as c, sqrt({sq('a.p', 'b.p', 2)}) as r, a.p[3] - b.p[3] as t from p a, b)",
        POLE_SQL,
    ),
)


def distances(spark, sf_dir):
    pairs = points.part2(spark, sf_dir).crossJoin(F.broadcast(_centres(spark)))
    return pairs.select("id", "c", r6(euclidean(F.col("p"), F.col("q"))).alias("r"), r6(dot(F.col("p"), F.col("q"))).alias("dot"))


register("distances", distances, with_points("part2", f"select id, c, {sql_r6(f'sqrt({sq('p', 'q', 2)})')} as r, {sql_r6('p[1]*q[1] + p[2]*q[2]')} as dot from p, c", CENTRE_SQL))


# boxes: one per part size group, compared with one another
def _boxes(spark, sf_dir):
    x = points.part2(spark, sf_dir).withColumn("g", F.pmod("id", F.lit(17)))
    x = x.withColumn("x", F.element_at("p", 1) / 4 + F.col("g") / 17.0).withColumn("y", F.element_at("p", 2) / 4 + F.pmod("g", F.lit(5)) / 5.0)
    return x.groupBy("g").agg(F.array(F.min("x"), F.min("y")).alias("lo"), F.array(F.max("x"), F.max("y")).alias("hi"), F.count("*").alias("n")).withColumn("leaf", F.col("g") % 3 == 0)


BOX_SQL = """b0 as (select id % 17 as g, p[1] / 4 + (id % 17) / 17.0::double as x, p[2] / 4 + ((id % 17) % 5) / 5.0::double as y from p),
b as (select g, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, g % 3 = 0 as leaf from b0 group by g),
j as (select a.g as ga, b.g as gb, a.leaf as la, b.leaf as lb,
  sqrt(power(a.x2-a.x1,2) + power(a.y2-a.y1,2)) / 2 as ra, sqrt(power(b.x2-b.x1,2) + power(b.y2-b.y1,2)) / 2 as rb,
  (a.x1+a.x2)/2 - (b.x1+b.x2)/2 as dx, (a.y1+a.y2)/2 - (b.y1+b.y2)/2 as dy,
  sqrt(power(greatest(a.x1-b.x2,0),2) + power(greatest(a.y1-b.y2,0),2) + power(greatest(b.x1-a.x2,0),2) + power(greatest(b.y1-a.y2,0),2)) as bd,
  (a.x1>=b.x1 and a.x2<=b.x2 and a.y1>=b.y1 and a.y2<=b.y2) or (b.x1>=a.x1 and b.x2<=a.x2 and b.y1>=a.y1 and b.y2<=a.y2) as inside
  from b a, b b)"""


def _box_pairs(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    side = lambda s: b.select(*[F.col(c).alias(f"{c}{s}") for c in ("g", "lo", "hi", "leaf")])
    return side("a").crossJoin(side("b"))  # 17 x 17


def _rule(name, column, case):
    register(
        f"admissibility_{name}",
        lambda spark, sf_dir: _box_pairs(spark, sf_dir).select("ga", "gb", column().alias("kind")),
        with_points("part2", f"select ga, gb, {case} as kind from j", BOX_SQL),
    )


_tail = "when la or lb then 'dense' else 'refine' end"
_rule("ball", lambda: geometry.compare_cluster("a", "b", 0.8), f"case when greatest(ra, rb) <= 0.8::double * greatest(0, sqrt(dx*dx+dy*dy) - ra - rb) then 'low_rank' {_tail}")
_rule("box", lambda: geometry.compare_cluster("a", "b", 0.8, geometry.box_distance), f"case when greatest(ra, rb) <= 0.8::double * bd then 'low_rank' {_tail}")
_rule("strict", lambda: geometry.compare_cluster_strict("a", "b"), f"case when not inside then 'low_rank' {_tail}")
_rule(
    "time_periodic",
    lambda: geometry.compare_cluster("a", "b", 0.8, geometry.time_periodic_distance),
    f"case when greatest(ra, rb) <= 0.8::double * greatest(0, sqrt(dx*dx + power(sin(dy*pi())/pi(),2)) - ra - rb) then 'low_rank' {_tail}",
)


def _caps(spark, sf_dir):
    """A cap for each label: the mean direction and a radius by the label's number of points."""
    x = points.sphere(spark, sf_dir)
    m = x.groupBy("f").agg(*[F.avg(F.element_at("p", k)).alias(f"m{k}") for k in (1, 2, 3)], F.count("*").alias("n"))
    size = F.sqrt(F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2") + F.col("m3") * F.col("m3"))
    return m.select(F.col("f").cast("long").alias("g"), F.array(F.col("m1") / size, F.col("m2") / size, F.col("m3") / size).alias("c"), (F.col("n") % 7 / 40.0).alias("r"))


def spherical(spark, sf_dir):
    x = _caps(spark, sf_dir)
    a, b = x.toDF("a", "ca", "ra"), x.toDF("b", "cb", "rb")
    d = geometry.spherical_distance(F.col("ca"), F.col("ra"), F.col("cb"), F.col("rb"))
    return a.crossJoin(b).where("a != b").select("a", "b", r6(d).alias("d"), geometry.admissible(F.col("ra"), F.col("rb"), d, F.lit(False), F.lit(False), 0.3).alias("kind"))


register(
    "admissibility_spherical",
    spherical,
    with_points(
        "sphere",
        f"select a, b, {sql_r6('d')} as d, case when greatest(ra, rb) <= 0.3::double * d then 'low_rank' else 'refine' end as kind from s",
        "m as (select f::bigint as g, avg(p[1]) as x, avg(p[2]) as y, avg(p[3]) as z, (count(*) % 7) / 40.0::double as r from p group by f)",
        "c as (select g, r, x / sqrt(x*x+y*y+z*z) as x, y / sqrt(x*x+y*y+z*z) as y, z / sqrt(x*x+y*y+z*z) as z from m)",
        "s as (select a.g as a, b.g as b, a.r as ra, b.r as rb, greatest(0::double, acos(greatest(-1::double, least(1::double, a.x*b.x+a.y*b.y+a.z*b.z))) - a.r - b.r) as d from c a, c b where a.g <> b.g)",
    ),
)


def box_distances(spark, sf_dir):
    c = [F.col(x) for x in ("loa", "hia", "lob", "hib")]
    return _box_pairs(spark, sf_dir).select("ga", "gb", r6(geometry.ball_distance(*c)).alias("ball"), r6(geometry.box_distance(*c)).alias("box"))


register("box_distances", box_distances, with_points("part2", f"select ga, gb, {sql_r6('greatest(0::double, sqrt(dx*dx+dy*dy) - ra - rb)')} as ball, {sql_r6('bd')} as box from j", BOX_SQL))


def points_in_boxes(spark, sf_dir):
    b = F.broadcast(_boxes(spark, sf_dir))  # 17 boxes
    x = points.part2(spark, sf_dir).crossJoin(b)
    return x.where(geometry.in_box(F.col("p"), F.col("lo"), F.col("hi"))).select("id", "g", r6(geometry.point_ball_distance(F.col("p"), F.col("lo"), F.col("hi"))).alias("d"))


register(
    "points_in_boxes",
    points_in_boxes,
    with_points(
        "part2",
        f"select p.id, b.g, {sql_r6('greatest(0::double, sqrt(power(p.p[1]-(x1+x2)/2,2)+power(p.p[2]-(y1+y2)/2,2)) - sqrt(power(x2-x1,2)+power(y2-y1,2))/2)')} as d from p, b where p.p[1] between x1 and x2 and p.p[2] between y1 and y2",
        BOX_SQL.split(",\nj as")[0],
    ),
)
