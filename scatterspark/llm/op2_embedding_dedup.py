"""Embedding near-duplicates with randomised-rotation binary codes.

Vectors are scaled to length 1, padded to ``CODE`` dimensions and rotated by a seeded random orthogonal matrix. The code
of a vector is the sign of each rotated coordinate; the correction factor <code/sqrt(CODE), vector> is stored with it.
<code_b/sqrt(CODE), a> / factor_b estimates <a, b> without bias, with an error of about
sqrt((1 - factor^2) / (factor^2 (CODE - 1))). Pairs whose estimate plus ``SIGMAS`` such errors stays below the threshold
are dropped; all others are recomputed exactly in double precision, and only that decides a link.

Which pairs are estimated at all: code bits of further random rotations are cut into bands, and vectors of one label
meet where a whole band agrees. Band width follows the size of the label (buckets of about ``BUCKET`` vectors for
spread-out data) and the number of bands follows the width, so that a pair at the threshold shares a band with
probability ``RECALL`` at least (pairs above it more likely). A pair that shares several bands counts in the first.

Equal vectors are one class from the start and count with their multiplicity. A bucket is cut into blocks of ``BLOCK``
vectors; a task sees two blocks, and returns link counts per vector and a spanning forest, never the pairs.

Edge cases: null labels, null or empty or zero vectors, vectors with a null or non-finite component or of another
dimension than the other one link with nothing; rows that share an id count as separate vectors; null ids
have no component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.common import connected_components, cut, saved, table

CODE, SIGMAS, RECALL, BUCKET, BLOCK, SEED = 128, 5.0, 0.9999, 256, 2048, 11


@functools.lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, code: int = CODE) -> np.ndarray:
    """x, padded with zeros to ``code`` dimensions, in rotated coordinates."""
    return x @ rotation(max(code, x.shape[1]), SEED)[: x.shape[1]]


def encode(x: np.ndarray, code: int = CODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs (+-1) and correction factors."""
    dim, r = max(code, x.shape[1]), rotated(x, code)
    signs = np.where(r >= 0, 1.0, -1.0)
    return r, signs, np.abs(r).sum(1) / math.sqrt(dim)


def stored(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """What is kept of unit vectors: their sign bits and correction factors."""
    _, signs, factors = encode(x)
    return [r.tobytes() for r in np.packbits(signs > 0, axis=1)], factors


def signs_of(codes: list[bytes], dim: int) -> np.ndarray:
    """+-1 from sign bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, count=max(CODE, dim))
    return bits * 2.0 - 1


def estimates(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <a_i, b_j> from a's vectors and b's codes, and their standard error by column."""
    (ra, _, _), (_, sb, fb) = a, b
    dim = ra.shape[1]
    return (ra @ sb.T) / math.sqrt(dim) / fb, np.sqrt(np.maximum(0, 1 - fb**2) / (fb**2 * (dim - 1)))


def bands(n: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors of one label."""
    bits = max(1, min(62, round(math.log2(max(2, n / bucket)))))
    if n <= bucket:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def band_keys(x: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The bands of unit vectors: one integer for each vector and band."""
    if not bits:
        return np.zeros((len(x), 1), np.int64)
    dim, out, seed = x.shape[1], [], SEED + 1
    planes = np.zeros((dim, 0))
    while planes.shape[1] < bits * count:
        planes = np.hstack([planes, rotation(dim, seed)])
        seed += 1
    signs = (x @ planes[:, : bits * count] >= 0).reshape(len(x), count, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up, out = list(range(n)), []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        if (p := top(i)) != (q := top(j)):
            up[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def compare(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block with another (or itself), counted in their first common band.

    Returns rows (rep, n, other): ``n`` more links of rep, counted with multiplicity, or a forest edge rep - other.
    """
    band, lo, hi, n = (int(part[c].iloc[0]) for c in ("band", "lo", "hi", "n"))
    left = part[part["block"] == lo].sort_values("rep")
    right = part[part["block"] == hi].sort_values("rep") if hi != lo else left
    if not len(left) or not len(right):
        return pd.DataFrame({"rep": [], "n": [], "other": []})
    va, vb = np.array(left["v"].tolist()), np.array(right["v"].tolist())
    na, nb = np.sqrt((va * va).sum(1)), np.sqrt((vb * vb).sum(1))
    dim = va.shape[1]
    est, err = estimates((rotated(va / na[:, None]), None, None), (None, signs_of(right["code"].tolist(), dim), right["factor"].to_numpy()))
    i, j = np.nonzero(est + SIGMAS * err >= threshold)
    if hi == lo:
        i, j = i[i < j], j[i < j]
    if band and len(i):
        bits, count = bands(n, threshold)
        ka, kb = band_keys(va / na[:, None], bits, count)[:, :band], band_keys(vb / nb[:, None], bits, count)[:, :band]
        new = np.concatenate([~(ka[i[k : k + (1 << 17)]] == kb[j[k : k + (1 << 17)]]).any(1) for k in range(0, len(i), 1 << 17)])
        i, j = i[new], j[new]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 17):
        p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
        keep[k : k + len(p)] = (va[p] * vb[q]).sum(1) / (na[p] * nb[q]) >= threshold
    i, j = i[keep], j[keep]
    ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
    ma, mb = left["copies"].to_numpy(), right["copies"].to_numpy()
    ids, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
    pa_, pb = at[: len(ra)], at[len(ra) :]
    n = np.bincount(pa_[i], mb[j], len(ids)) + np.bincount(pb[j], ma[i], len(ids))
    edges = _forest(len(ids), pa_[i], pb[j])
    has = np.flatnonzero(n)
    rep = np.concatenate([ids[has], ids[[e[0] for e in edges]]]) if len(has) else ids[:0]
    other = np.concatenate([np.full(len(has), -1), [e[1] for e in edges]]) if len(has) else ids[:0]
    out = pd.DataFrame({"rep": rep, "n": np.concatenate([n[has], np.zeros(len(edges))]).astype("int64")})
    out["other"] = pd.array([None if o < 0 else int(ids[int(o)]) for o in other], dtype="Int64")
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row."""
    kind = vectors.schema["label"].dataType.simpleString()
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # divided by the power of two at the largest component, which is exact and keeps squares within range
    v = v.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x))))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & ~odd & (F.col("top") > 0) & F.col("vec_id").isNotNull()
    fine = F.coalesce(fine, F.lit(False))
    unit = F.pow(F.lit(2.0), F.floor(F.log2("top")))
    good = v.where(fine).select("vec_id", "label", F.transform("v", lambda x: x / unit).alias("v"))
    # classes of equal vectors, numbered, as rows that share an id may hold other vectors
    key = ["label", "h1", "h2"]
    member = saved(good.select("vec_id", "label", F.xxhash64("v").alias("h1"), F.md5(F.to_json("v")).alias("h2"), "v"))
    classes = member.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = saved(classes.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rep")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))

    def place(frames):
        for f in frames:
            for (n, _), g in f.groupby(["n", "dim"], sort=False):
                x = np.array(g["v"].tolist())
                x = x / np.sqrt((x * x).sum(1))[:, None]
                bits, count = bands(int(n), threshold)
                keys = band_keys(x, bits, count)
                code, factor = stored(x)
                for b in range(count):
                    yield g.assign(band=b, key=keys[:, b], code=code, factor=factor)[["label", "dim", "n", "band", "key", "rep", "copies", "code", "factor", "v"]]

    placed = classes.join(sizes, ["label", "dim"]).select("label", "dim", "n", "rep", "copies", "v")
    placed = placed.mapInPandas(place, f"label {kind}, dim int, n long, band int, key long, rep long, copies long, code binary, factor double, v array<double>")
    bucket = ["label", "dim", "band", "key"]
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    blocked = placed.join(counts.where("m > 1").select(*bucket, blocks.alias("nb")), bucket).withColumn("block", F.pmod(F.xxhash64("rep"), "nb").cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    tasks = blocked.select(*bucket, "n", "rep", "copies", "code", "factor", "v", "block", F.explode(every).alias("p")).select("*", "p.lo", "p.hi").drop("p")

    found = cut(tasks.groupBy(*bucket, "lo", "hi").applyInPandas(lambda part: compare(part, threshold), "rep long, n long, other long"))
    links = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    component = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    parts = classes.select(*key, "rep", "copies", "first").join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    top = parts.groupBy("part").agg(F.min("first").alias("component_id"))
    result = parts.join(top, "part").join(links, "rep", "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = member.select("vec_id", *key).join(result, key).select("vec_id", "n_links", "component_id")
    alone = v.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings),
g as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from v
      where label is not null and v is not null and len(v) > 0 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x)))),
e as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where a.norm > 0 and b.norm > 0 and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
n as (select a, count(*) as n from e group by a),
r as (select vec_id as a, vec_id as c from embeddings
      union select e.a, r.c from e join r on e.b = r.a where r.c < e.a),
m as (select a, min(c) as component_id from r group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join m on vec_id = m.a left join n on vec_id = n.a
"""
