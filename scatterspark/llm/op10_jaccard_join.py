"""Exact Jaccard join of word-shingle sets with a token-group matrix.

Documents with equal sets are one class from the start, known by 128 bits of its set; a component is named by the
smallest id in it. The join then runs in steps that
each drop only what provably has no link at the threshold t (a link needs overlap >= ceil(t * size) on both sides):

1. Hash-ordered prefixes. Two linked sets share at least k of their size - ceil(t size) + k smallest hashes. A class
   with fewer than k hashes of its prefix in any other class can't link (k is a tenth of the needed overlap).
2. For the classes left, frequencies of all their shingles among them: a class needs ceil(t size) shingles that occur
   in another one. Then rarest-first prefixes index the rest, so passages that many documents share hardly count.
3. Groups. Every posting list is linked to its first member only (verified exactly), and components of these links
   partition the classes into similar documents; large ones are cut into groups of about ``GROUP`` classes.
4. Token-group matrix: (shingle, component) for the union of each component's prefixes, with the most shared shingles
   that a member has from there on, and each group's whole union. A class meets a larger component where they share a
   prefix shingle that, as their first common one, leaves enough overlap; it qualifies for those groups of it whose
   union holds ceil(t size) of its shingles. Only then are the members opened, filtered by the most overlap that their
   sizes and shared shingles allow, and verified exactly.

Pairs inside a group are thus never spelled out, hot shingles cost one row a document, and no link is lost.

Edge cases: null, empty and blank texts have no shingles, link with nothing and are their own component; texts of fewer
than five words have their whole word sequence as one shingle; rows that share an id are told apart by their text; rows with a null id
can't be named, so they keep a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterspark.llm.arrow import by_slices
from scatterspark.llm.common import connected_components, forget, saved, table
from scatterspark.llm.shingles import mix, shingle_sets

WORDS, PERCENT, GROUP, SHARE = 5, 75, 64, 0.1


def need(n, percent: int):
    """Smallest overlap of a set of n that can reach the threshold."""
    return -(-percent * n // 100)


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0)).cast("long")


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s)).astype(np.int64))


def prefixes(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(doc_id, n, s1, s2, prefix array<long>)``: size of each set, 128 bits that stand for it and its smallest hashes.

    Sets that can't link, because they are empty or their row has no id, have an empty prefix.
    """

    def fn(keys, texts):
        sets = shingle_sets(texts, words)
        sig = [_signature(s) for s in sets]
        cutoff = [0 if k is None or not len(s) else len(s) - need(len(s), percent) + max(1, int(SHARE * len(s))) for k, s in zip(keys, sets)]
        return {
            "doc_id": keys, "n": [len(s) for s in sets], "s1": [a for a, _ in sig], "s2": [b for _, b in sig],
            "prefix": [s[:c].astype(np.int64) for s, c in zip(sets, cutoff)],
        }

    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.list_(pa.int64()))])
    return documents.select("doc_id", "text").mapInArrow(by_slices(fn, arrow), "doc_id long, n long, s1 long, s2 long, prefix array<long>")


def whole_sets(documents: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``(rep, n, tokens array<long>)`` of the classes ``wanted(rep, doc_id, n, s1, s2)``, doc_id being one of their documents.

    A bit set of fixed size, hashed from the ids, keeps other documents from being shuffled; the join makes it exact.
    """
    bits = 1 << 22
    slots = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("b"))
    word = slots.groupBy((F.col("b") / 32).cast("int").alias("w")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("b") % 32).cast("long")).alias("v"))
    mask = np.zeros(bits // 32, np.uint32)
    for w, v in word.collect():  # at most bits / 32 rows
        mask[w] = v
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(mask)

    def pick(batches):
        for batch in batches:
            b = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((shared.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1)).select([0, 1])

    def fn(keys, texts):
        sets = shingle_sets(texts, words)
        sig = [_signature(s) for s in sets]
        return {"doc_id": keys, "n": [len(s) for s in sets], "s1": [a for a, _ in sig], "s2": [b for _, b in sig], "tokens": [s.astype(np.int64) for s in sets]}

    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    slices = by_slices(fn, arrow)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("b")
    found = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", slot).mapInArrow(lambda it: slices(pick(it)), "doc_id long, n long, s1 long, s2 long, tokens array<long>")
    # rows that share an id may hold other texts; equal rows leave one set
    return found.join(wanted, ["doc_id", "n", "s1", "s2"]).select("rep", "n", "tokens").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def join_components(documents: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row."""
    rows = saved(prefixes(documents, percent, words))
    members = saved(rows.drop("prefix"))
    classes = members.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    # a class goes by its smallest id, so that originals head the posting lists; further classes of that id get numbers far below
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "s1", "s2")) > 1
    classes = saved(classes.withColumn("rep", F.when(again, -(1 << 62) - 1 - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))))

    # 1. hash-ordered prefixes: copies let their class through, what stays is decided by other classes in the next step
    tokens = rows.select("doc_id", F.explode("prefix").alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h")
    counts = tokens.join(shared, "h").groupBy("doc_id").agg(F.count("*").alias("c"))  # rows that share an id only add up
    least = F.greatest(F.lit(1), F.floor(SHARE * _need(F.col("n"), percent)))
    left = saved(counts.join(classes, "doc_id").where(F.col("c") >= least).select("rep", "doc_id", "n", "s1", "s2"))
    forget(rows)

    # 2. frequencies among the classes left, rarest-first prefixes
    sets = saved(whole_sets(documents, left, words))
    tokens = sets.select("rep", "n", F.explode("tokens").alias("h"))
    df = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    common = tokens.join(df, "h").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    common = common.where(F.size("x") >= _need(F.col("n"), percent))
    take = F.col("n") - _need(F.col("n"), percent) + 1 - (F.col("n") - F.size("x"))
    index = common.where(take > 0).select("rep", "n", F.size("x").alias("c"), F.posexplode(F.slice("x", 1, take.cast("int"))).alias("i", "x"))
    index = saved(index.select("rep", "n", "c", F.col("x.h").alias("h"), (F.col("c") - F.col("i")).alias("rest")))

    # 3. link every posting list to its first member; components are the groups
    heads = index.groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("h", "a")
    star = index.join(heads, "h").where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    links = saved(_verified(star, sets, percent))
    component = connected_components(links).withColumnsRenamed({"node": "rep", "component": "part"})
    parts = index.select("rep", "n", "c").distinct().join(component, "rep", "left").select("rep", "n", "c", F.coalesce("part", "rep").alias("part"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    grouped = parts.join(sizes, "part").select("rep", "n", "c", "part", "size", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / GROUP)).alias("chunk"))
    grouped = saved(grouped)

    # 4. token-group matrix between different components
    matrix = index.drop("c").join(grouped.select("rep", "part", "size"), "rep")
    columns = matrix.groupBy("h", F.col("part").alias("gp"), F.col("size").alias("gs")).agg(F.max("rest").alias("grest"), F.min("n").alias("gn"))
    queries = matrix.select(F.col("rep").alias("q"), "h", "part", "size", F.col("n").alias("qn"), "rest")
    most = F.least("rest", "grest")  # a pair's overlap if h is its first common shingle
    larger = (F.col("gs") > F.col("size")) | ((F.col("gs") == F.col("size")) & (F.col("gp") > F.col("part")))
    reach = 100 * most >= percent * (F.col("qn") + F.col("gn") - most)
    candidates = queries.join(columns, (queries["h"] == columns["h"]) & larger & reach).select("q", "gp").distinct()
    candidates = candidates.join(grouped.select(F.col("part").alias("gp"), F.col("chunk").alias("gc")).distinct(), "gp")
    union = (
        sets.join(grouped.select("rep", "part", "chunk"), "rep")
        .groupBy(F.col("part").alias("gp"), F.col("chunk").alias("gc"))
        .agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("u"))  # about GROUP sets
    )
    asked = sets.join(grouped.select("rep", "c"), "rep").select(F.col("rep").alias("q"), F.col("n").alias("nq"), F.col("c").alias("cq"), F.col("tokens").alias("tq"))
    opened = candidates.join(asked, "q").join(union, ["gp", "gc"]).where(F.size(F.array_intersect("tq", "u")) >= _need(F.col("nq"), percent)).select("q", "nq", "cq", "gp", "gc")
    inside = grouped.select(F.col("part").alias("gp"), F.col("chunk").alias("gc"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    most = F.least("cq", "cb")  # neither has more shingles that occur elsewhere
    fits = 100 * most >= percent * (F.col("nq") + F.col("nb") - most)
    across = opened.join(inside, (opened["gp"] == inside["gp"]) & (opened["gc"] == inside["gc"]) & fits).select(F.col("q").alias("a"), "b")
    final = connected_components(links.union(_verified(across, sets, percent)))

    # a component is named by its smallest id, which several classes may have where rows share an id
    parts = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", "doc_id", F.coalesce("component", "rep").alias("part"))
    top = parts.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    ids = parts.join(top, "part").select("n", "s1", "s2", "component_id")
    return members.select("doc_id", "n", "s1", "s2").join(ids, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def query(spark, sf_dir):
    return join_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then []
                      when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
t as (select doc_id, len(s)::bigint as n, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as inter
      from t a join t b on a.t = b.t and a.doc_id <> b.doc_id group by all),
l as (select a, b from p where 100 * inter >= 75 * (na + nb - inter)),
r as (select doc_id as a, doc_id as c from documents
      union select l.a, r.c from l join r on l.b = r.a where r.c < l.a),
m as (select a, min(c) as component_id from r group by a)
select s.doc_id, len(s)::bigint as n_shingles, component_id from s join m on s.doc_id = m.a
"""
