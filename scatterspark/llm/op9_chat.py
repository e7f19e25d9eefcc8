"""Multi-party perspective rotation of conversations (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all
others as named users; the loss mask covers exactly the assistant's content (with its end marker).

Edge cases: a null text is empty; null roles form the participant ``unknown``, together with a role of that name; equal turn numbers are ordered by role
and text, repeated rows stay repeated; rows with a null turn come first; control markers inside texts and roles are broken up and
line breaks in roles become blanks, so that they can't be taken for structure; an empty table gives no rows; further input columns are ignored. A conversation
of more than ``turns_per_segment`` turn numbers is rendered in segments by turn number, None renders it whole. Rows of a
conversation that have no turn number, or the same one, are gathered in one segment however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.common import table

START, END = "<|start|>", "<|end|>"


def _header(role: Column, own: Column, fixed: Column) -> Column:
    for sign, plain in (("<|", "< |"), ("\n", " "), ("\r", " ")):
        role = F.replace(role, F.lit(sign), F.lit(plain))
    kind = F.when(fixed, role).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), kind, F.lit("\n"))


def rotate(turns: DataFrame, fixed_roles: tuple[str, ...] = ("system",), turns_per_segment: int | None = 256) -> DataFrame:
    """``(conv_id, perspective, segment, n_turns, rendered, mask array<struct<start,end>>)``.

    ``fixed_roles`` take no perspective and keep their role. Mask positions are code points of ``rendered``, end
    exclusive.
    """
    t = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / turns_per_segment) if turns_per_segment else F.lit(0), F.lit(0)).cast("long").alias("segment"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< |").alias("text"),
        ).alias("t"),
    )
    speakers = t.where(~F.col("t.role").isin(*fixed_roles)).select(F.col("conv_id").alias("c"), F.col("t.role").alias("perspective")).distinct()
    whole = t.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rows = whole.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def add(acc: Column, x: Column) -> Column:
        head = _header(x["role"], x["role"] == F.col("perspective"), x["role"].isin(*fixed_roles))
        start = acc["at"] + F.length(head)
        stop = start + F.length(x["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), stop.alias("end")))
        own = (x["role"] == F.col("perspective")) & ~x["role"].isin(*fixed_roles)
        return F.struct(
            F.concat(acc["out"], F.array(F.concat(head, x["text"], F.lit(END + "\n")))).alias("out"),
            (stop + 1).alias("at"),
            F.when(own, F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"),
        )

    empty = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")
    )
    r = F.aggregate("ts", empty, add)
    return rows.withColumn("r", r).select(
        "conv_id",
        "perspective",
        "segment",
        F.size("ts").alias("n_turns"),
        F.array_join("r.out", "").alias("rendered"),
        F.col("r.mask").alias("mask"),
    )


def query(spark, sf_dir):
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", F.col("segment").cast("long").alias("segment"), F.col("n_turns").cast("long").alias("n_turns"), "rendered", spans.alias("mask")
    )


ORACLE = r"""
with t as (
  select conv_id, replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' '), chr(13), ' ') as shown, coalesce(floor(turn / 256.0), 0)::bigint as segment, turn, coalesce(role, 'unknown') as role,
         replace(coalesce(text, ''), '<|', '< |') as text from conversations),
s as (select distinct conv_id as c, role as perspective from t where role <> 'system'),
j as (
  select conv_id, perspective, segment, turn, role, text,
         '<|start|>' || case when role = 'system' then shown when role = perspective then 'assistant'
                             else 'user name=' || shown end || chr(10) as head
  from t join s on conv_id is not distinct from c),
n as (
  select *, row_number() over (partition by conv_id, perspective, segment
                               order by turn nulls first, role, text) as k from j),
p as (
  select *, coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, perspective, segment order by k
                     rows between unbounded preceding and 1 preceding), 0) as at0 from n)
select conv_id, perspective, segment, count(*) as n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' order by k) as rendered,
       coalesce(string_agg((at0 + length(head))::bigint::varchar || ':' || (at0 + length(head) + length(text) + 7)::bigint::varchar,
                ',' order by k) filter (where role = perspective), '') as mask
from p group by conv_id, perspective, segment
"""
