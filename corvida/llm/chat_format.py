"""Chat formatting in DataFrame functions: each conversation once from every participant's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS, DENSE = 64, 4096


def _clean(c: Column) -> Column:
    """Marks inside a message are broken up, so that a text can't open or close one."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|", "< |")


def _subs(messages: DataFrame, dense: int) -> DataFrame:
    """messages with `sub`, their place in their part by turn, role and text over `dense`. Places are counted within
    slices of the sorted table, so no part is gathered, and moved by what its earlier slices hold."""
    order, part = ["turn", "role", "text"], ["conv_id", "part"]
    slices = cut(messages.repartitionByRange(*part, *order).withColumn("slice", F.spark_partition_id()), "slices")
    sizes = slices.groupBy(*part, "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("slice").alias("_s"), before.alias("start")), "starts")
    own = F.row_number().over(Window.partitionBy(*part, "slice").orderBy(*order)) - 1
    found = slices.withColumn("own", own).join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("slice") == F.col("_s")))
    return found.select(*messages.columns, F.floor((F.col("start") + F.col("own")) / dense).cast("long").alias("sub"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_per_part: int = TURNS, dense: int = DENSE) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, sub, n_messages, n_trained, rendered, mask.

    Seen from `speaker`, their own messages are the assistant's, those of others are a named user's, and `system`
    messages stay the system's (system is no participant, so a conversation of system messages alone gives no row). mask
    lists "start:end" in code points of `rendered`: what is trained on, the assistant's text with its closing mark.
    A part covers turns_per_part turn numbers, and a sub `dense` consecutive messages of it by turn, role and text, from
    0 on, so a conversation of any length is never gathered whole; its parts in order of part and sub, joined, are the
    dialogue.

    A null text is an empty message, a null role the speaker `unknown`, a null turn comes first in a part of its own
    (-1), a null conv_id is a conversation too. Messages that agree in all four columns are one. Several messages of a
    turn are ordered by role and text. Other columns are left out; an empty table gives an empty result.
    """
    turn = F.col(turn_col).cast("long")
    messages = turns.select(
        F.col(conv_col).alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), _clean(F.col(text_col)).alias("text"),
        F.coalesce(F.floor(turn / turns_per_part).cast("long"), F.lit(-1).cast("long")).alias("part"),
    ).distinct()
    messages = cut(messages, "messages")
    speakers = cut(messages.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers")), "speakers")
    full = messages.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > dense)
    if full.isEmpty():  # sub 0 holds all of every part
        dealt = messages.withColumn("sub", F.lit(0).cast("long"))
    else:
        full = cut(full.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p")), "dense")
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
        dealt = messages.join(full, same, "left_anti").withColumn("sub", F.lit(0).cast("long"))
        dealt = dealt.unionByName(_subs(messages.join(full, same, "left_semi"), dense))
    parts = cut(dealt.groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")), "parts")
    sides = parts.join(speakers.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumn("speaker", F.explode("speakers"))

    def head(m: Column) -> Column:
        name = F.when(m.role == F.col("speaker"), F.lit("assistant")).when(m.role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), F.regexp_replace(m.role, r"[\s<|>]+", "_")))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    lines = F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m.text, F.lit(CLOSE)).alias("body"), (m.role == F.col("speaker")).alias("own")))
    walked = F.aggregate(
        "lines",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask")),
        lambda acc, m: F.struct(
            (acc.at + F.length(m.head) + F.length(m.body) + 1).alias("at"),
            F.when(m.own, F.array_append(acc.mask, F.concat_ws(":", (acc.at + F.length(m.head)).cast("string"), (acc.at + F.length(m.head) + F.length(m.body)).cast("string")))).otherwise(acc.mask).alias("mask"),
        ),
    ).mask
    return sides.withColumn("lines", lines).select(
        "conv_id", "speaker", "part", "sub", F.size("lines").alias("n_messages"), F.size(F.filter("lines", lambda m: m.own)).alias("n_trained"),
        F.array_join(F.transform("lines", lambda m: F.concat(m.head, m.body, F.lit("\n"))), "").alias("rendered"), F.array_join(walked, ",").alias("mask"),
    )


ORACLE = f"""
with d as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text,
         coalesce(cast(floor(turn / {TURNS}.0) as bigint), -1) as part from conversations),
m as (select *, (row_number() over (partition by conv_id, part order by turn nulls first, role, text) - 1) // {DENSE} as sub from d),
s as (select distinct conv_id, role as speaker from m where role <> 'system'),
l as (
  select m.conv_id, s.speaker, m.part, m.sub, m.turn, m.role, m.text, m.role = s.speaker as own,
         '<|im_start|>' || case when m.role = s.speaker then 'assistant' when m.role = 'system' then 'system'
            else 'user name=' || regexp_replace(m.role, '[\\s<|>]+', '_', 'g') end || chr(10) as head, m.text || '<|im_end|>' as body
  from m join s on m.conv_id is not distinct from s.conv_id),
o as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, speaker, part, sub order by turn nulls first, role, text
         rows between unbounded preceding and 1 preceding), 0) as pos from l)
select conv_id, speaker, part, cast(sub as bigint) as sub, cast(count(*) as integer) as n_messages, cast(count(*) filter (where own) as integer) as n_trained,
       string_agg(head || body || chr(10), '' order by turn nulls first, role, text) as rendered,
       coalesce(string_agg(cast(pos + length(head) as bigint) || ':' || cast(pos + length(head) + length(body) as bigint), ',' order by turn nulls first, role, text) filter (where own), '') as mask
from o group by conv_id, speaker, part, sub
"""
