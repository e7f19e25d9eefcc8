"""Cluster trees, node boxes, orders and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scatterspark.operators import neighbours, trees
from scatterspark.plans.base import r6, register, sq, sql_r6, with_points
from scatterspark.sources import points


def _split_sql(levels: int, least: int, geometric: bool = False) -> tuple[str, ...]:
    """Chained statements, one a level, for two-dimensional points; leaves keep their path and level."""
    out = [
        "t0 as (select id, p[1] as x, p[2] as y, 1::bigint as path, 0 as level, min(p[1]) over () as lx, max(p[1]) over () as hx, min(p[2]) over () as ly, max(p[2]) over () as hy from p)"
    ]
    for k in range(levels):
        out.append(f"a{k} as (select *, count(*) over (partition by path) as n, hx - lx >= hy - ly as ax, case when hx - lx >= hy - ly then x else y end as v from t{k})")
        if geometric:
            out.append(f"r{k} as (select *, v > case when ax then lx + (hx - lx) / 2 else ly + (hy - ly) / 2 end as rt, case when ax then lx + (hx - lx) / 2 else ly + (hy - ly) / 2 end as e, n > {2 * least - 1} as s from a{k})")
            end_l = end_r = "e"
        else:
            out.append(f"r{k} as (select *, row_number() over (partition by path order by v, id) > n // 2 as rt, n > {2 * least - 1} as s from a{k})")
            end_l, end_r = "max(case when not rt then v end) over (partition by path)", "min(case when rt then v end) over (partition by path)"
        out.append(
            f"t{k + 1} as (select id, x, y, case when s then 2 * path + rt::bigint else path end as path, case when s then level + 1 else level end as level,"
            f" case when s and ax and rt then {end_r} else lx end as lx, case when s and ax and not rt then {end_l} else hx end as hx,"
            f" case when s and not ax and rt then {end_r} else ly end as ly, case when s and not ax and not rt then {end_l} else hy end as hy from r{k})"
        )
    return tuple(out)


NODES_SQL = (
    "m as (select id, x, y, path >> (level - k) as path, k::int as level from (select *, unnest(range(0, level + 1)) as k from t{l}))",
    "nodes as (select path, level, count(*) as n, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from m group by path, level)",
)
LEVELS, LEAST = 5, 20


def _tree(spark, sf_dir, rule="cardinality"):
    return trees.cluster_tree(points.part2(spark, sf_dir), LEAST, LEVELS, rule)


def _members(rule):
    return lambda spark, sf_dir: _tree(spark, sf_dir, rule).select("id", "path", "level")


register("cluster_tree", _members("cardinality"), with_points("part2", f"select id, path, level::int as level from t{LEVELS}", *_split_sql(LEVELS, LEAST)))
register("geometric_tree", _members("geometric"), with_points("part2", f"select id, path, level::int as level from t{LEVELS}", *_split_sql(LEVELS, LEAST, True)))


def node_boxes(spark, sf_dir):
    n = trees.numbered(trees.nodes(_tree(spark, sf_dir), 2))
    cols = [r6(F.element_at(c, k)).alias(f"{c}{k}") for c in ("lo", "hi") for k in (1, 2)]
    return n.select("path", "level", "n", "block_id", *cols)


register(
    "node_boxes",
    node_boxes,
    with_points(
        "part2",
        f"select path, level, n, row_number() over (order by level, path) - 1 as block_id, {sql_r6('lx')} as lo1, {sql_r6('ly')} as lo2, {sql_r6('hx')} as hi1, {sql_r6('hy')} as hi2 from nodes",
        *_split_sql(LEVELS, LEAST),
        *[s.format(l=LEVELS) for s in NODES_SQL],
    ),
)


def level_counts(spark, sf_dir):
    return trees.nodes(_tree(spark, sf_dir), 2).groupBy("level").agg(F.count("*").alias("clusters"), F.sum("n").alias("points"))


register(
    "tree_levels",
    level_counts,
    with_points("part2", "select level, count(*) as clusters, sum(n)::bigint as points from nodes group by level", *_split_sql(LEVELS, LEAST), *[s.format(l=LEVELS) for s in NODES_SQL]),
)


def discrepancies(spark, sf_dir):
    d = trees.discrepancy(trees.nodes(_tree(spark, sf_dir), 2))
    return d.agg(r6(F.min("discrepancy")).alias("least"), r6(F.max("discrepancy")).alias("most"), r6(F.avg("discrepancy")).alias("mean"), F.count("*").alias("n"))


register(
    "tree_discrepancy",
    discrepancies,
    with_points(
        "part2",
        f"select {sql_r6('min(d)')} as least, {sql_r6('max(d)')} as most, {sql_r6('avg(d)')} as mean, count(*) as n from d",
        *_split_sql(LEVELS, LEAST),
        *[s.format(l=LEVELS) for s in NODES_SQL],
        "root as (select n as rn, (hx-lx)*(hy-ly) as rv from nodes where path = 1)",
        "d as (select abs(n / rn - (hx-lx)*(hy-ly) / rv) as d from nodes, root where path > 1 and n > 1)",
    ),
)


def cluster_order(spark, sf_dir):
    """Position of each point in cluster order, and the value that stands there."""
    x = trees.morton_tree(points.part2(spark, sf_dir), 3)
    f = points.part2(spark, sf_dir).select("id", "f")
    return x.join(f, "id").select("pos", "id", "f")


_MORTON = "(" + " + ".join(f"(((qx >> {b}) & 1) << {2 * b + 1}) + (((qy >> {b}) & 1) << {2 * b})" for b in range(16)) + ")"
MORTON_SQL = (
    "e as (select min(p[1]) as lx, max(p[1]) as hx, min(p[2]) as ly, max(p[2]) as hy from p)",
    "q as (select id, p, f, greatest(0, least(65535, floor((p[1]-lx)/(hx-lx)*65536)))::bigint as qx, greatest(0, least(65535, floor((p[2]-ly)/(hy-ly)*65536)))::bigint as qy from p, e)",
    f"o as (select id, p, f, row_number() over (order by {_MORTON}, id) - 1 as pos, count(*) over () as size from q)",
)
register("cluster_order", cluster_order, with_points("part2", "select pos, id, f from o", *MORTON_SQL))


def morton_halves(levels):
    out = ["h0 as (select id, p, f, pos, 1::bigint as path, 0::bigint as lo, size from o)"]
    for k in range(levels):
        out.append(
            f"h{k + 1} as (select id, p, f, pos, path * 2 + (pos >= lo + size // 2)::bigint as path, case when pos >= lo + size // 2 then lo + size // 2 else lo end as lo,"
            f" case when pos >= lo + size // 2 then size - size // 2 else size // 2 end as size from h{k})"
        )
    return tuple(out)


def morton(spark, sf_dir):
    return trees.morton_tree(points.part2(spark, sf_dir), 6).select("id", "path", "pos")


register("morton_tree", morton, with_points("part2", "select id, path, pos from h6", *MORTON_SQL, *morton_halves(6)))


def unit_kd(spark, sf_dir):
    return trees.unit_kd_tree(points.part2(spark, sf_dir), 4).select("id", "path")


_CELL = "greatest(0, least(15, floor(p[{}] * 16)))::bigint"
_UNIT = "(" + " + ".join(f"(((cx >> {b}) & 1) << {2 * b + 1}) + (((cy >> {b}) & 1) << {2 * b})" for b in range(4)) + " + 256)"
_UNIT_SQL = f"select id, {_UNIT} as path from (select id, {_CELL.format(1)} as cx, {_CELL.format(2)} as cy from p)"
register("unit_kd_tree", unit_kd, with_points("part2", _UNIT_SQL))
register("unit_binary_tree", lambda spark, sf_dir: trees.unit_binary_tree(points.part2(spark, sf_dir), 4).select("id", "path", "level"), with_points("part2", _UNIT_SQL.replace("select id,", "select id, 8 as level,", 1)))


def projection_tree(spark, sf_dir):
    """Sizes stay balanced: leaves of a random projection tree hold about n / 2^levels points."""
    x = trees.random_projection_tree(points.part2(spark, sf_dir), 4, 3)
    n = x.count()
    g = x.groupBy("path").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("leaves"), (F.max(F.abs(F.col("n") - n / 16.0)) <= n * 0.02 + 8).alias("balanced"))


register("random_projection_tree", projection_tree, "select 16::bigint as leaves, true as balanced")


def statistics(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    d = neighbours.min_distance(x)
    return d.agg(r6(F.max("dist")).alias("fill_distance"), r6(F.min("dist") / 2).alias("separation_radius"), r6(F.min("dist")).alias("min_distance"), F.sum((F.col("dist") < 2.220446049250313e-16).cast("long")).alias("duplicates"))


_NEAREST = f"d as (select a.id, min(sqrt({sq('a.p', 'b.p', 2)})) as dist from p a join p b on a.id <> b.id group by a.id)"
register(
    "point_statistics",
    statistics,
    with_points("part2", f"select {sql_r6('max(dist)')} as fill_distance, {sql_r6('min(dist)/2')} as separation_radius, {sql_r6('min(dist)')} as min_distance, sum((dist < 2.220446049250313e-16)::int)::bigint as duplicates from d", _NEAREST),
)


def distance_histogram(drop):
    def query(spark, sf_dir):
        d = neighbours.min_distance(points.part2(spark, sf_dir)).select(F.round("dist", 9).alias("dist"))
        return trees.histogram(d, "dist", 15, drop)

    last = 15 if drop else 14
    sql = with_points(
        "part2",
        "select bin, count(*) as n from b where bin < 15 group by bin",
        _NEAREST,
        "e as (select round(dist, 9) as dist, min(round(dist, 9)) over () as a, max(round(dist, 9)) over () as b from d)",
        f"b as (select case when dist = b then {last} else floor((dist - a) / ((b - a) / 15)) end::int as bin from e)",
    )
    return query, sql


register("distance_histogram", *distance_histogram(False))
register("distance_histogram_open", *distance_histogram(True))


def discrepancy_histogram(spark, sf_dir):
    d = trees.discrepancy(trees.nodes(_tree(spark, sf_dir), 2)).select(F.round("discrepancy", 7).alias("d"))
    return trees.histogram(d, "d", 15, log=True)


register(
    "discrepancy_histogram",
    discrepancy_histogram,
    with_points(
        "part2",
        "select bin, count(*) as n from b group by bin",
        *_split_sql(LEVELS, LEAST),
        *[s.format(l=LEVELS) for s in NODES_SQL],
        "root as (select n as rn, (hx-lx)*(hy-ly) as rv from nodes where path = 1)",
        "d as (select round(abs(n / rn - (hx-lx)*(hy-ly) / rv), 7) as d from nodes, root where path > 1 and n > 1)",
        "e as (select ln(d) as v, min(ln(d)) over () as a, max(ln(d)) over () as b from d where d > 0)",
        "b as (select case when v = b then 14 else floor((v - a) / ((b - a) / 15)) end::int as bin from e)",
    ),
)


def nested_subsample(spark, sf_dir):
    x = points.part2(spark, sf_dir)
    kept = x.where("id <= 10").select("id")
    one = trees.subsample(x, kept, 2)
    return trees.subsample(x, one, 3)


def _sub(n, kept, level):
    s = 1 << level
    c = lambda k: f"greatest(0, least({s - 1}, floor(p[{k}] * {s})))"
    return (
        f"c{n} as (select id, {c(1)} as cx, {c(2)} as cy, power(p[1] - ({c(1)} + 0.5::double) / {s}, 2) + power(p[2] - ({c(2)} + 0.5::double) / {s}, 2) as dist from p where id not in (select id from {kept}))",
        f"s{n} as (select id from {kept} union all select id from (select id, row_number() over (partition by cx, cy order by dist, id) as r from c{n}) where r = 1)",
    )


register("nested_subsample", nested_subsample, with_points("part2", "select id from s2", "s0 as (select id from p where id <= 10)", *_sub(1, "s0", 2), *_sub(2, "s1", 3)))
