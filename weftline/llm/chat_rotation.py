"""Chat formatting by perspective rotation: each participant in turn is the assistant.

For every participant of a conversation the dialogue is rendered with that speaker's turns as the
assistant's, all others' as a named user's and system turns as they are; spans mark the characters to be
learned: the speaker's own content with its end mark. A dialogue is rendered in parts of `part_turns` turn
numbers, so a conversation of any length, also one with a third of all rows, is dealt over many tasks; a
usual one is a single part. All work on turns shares one exchange, by (conversation, part).

Defined cases: a null text is empty, a null role the participant "unknown"; rows without a turn number form
a part of their own, -1, and parts of negative turn numbers count down from -2; equal turn numbers are ordered by role, then text, and repeated rows are rendered
each; control marks in a text or role are broken up by a space, and control characters and line breaks in a role are one
space where it names a user (`speaker` is the role as it is); an empty role is a participant with an empty name; conversations of system turns alone have no
participant and no row; an empty table gives an empty result. Offsets of spans count from the start of their part.
Only the named columns are read, so others may have any name. A very long text is rendered whole. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatParams:
    part_turns: int = 1024
    system_role: str = "system"


def plain(text: Column) -> Column:
    """Without control marks: a mark's first two characters are parted, also where taking one apart would leave another."""
    return F.regexp_replace(text, r"<(?=\|)", "< ")


def name_of(role: Column) -> Column:
    """A role as it stands in a head: without control marks, in one line."""
    return plain(F.regexp_replace(role, r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+", " "))


def rotate(conversations: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, part_no, speaker, n_turns, dialogue, spans (array of start and end, code points)."""
    turns = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / p.part_turns) - (F.col("turn") < 0).cast("long"), F.lit(-1)).cast("long").alias("part_no"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    speakers = turns.where(F.col("role") != p.system_role).groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    parts = turns.select("conv_id", "part_no").distinct()
    known = parts.join(speakers.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(F.col("conv_id").alias("_conv"), F.col("part_no").alias("_part"), "speakers")
    rows = turns.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part_no") == F.col("_part"))).select("conv_id", "part_no", "turn", "role", "text", F.explode("speakers").alias("speaker"))

    own = F.col("role") == F.col("speaker")
    head = F.when(own, f"{OPEN}assistant\n").when(F.col("role") == p.system_role, f"{OPEN}system\n").otherwise(F.concat(F.lit(f"{OPEN}user name="), name_of(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit(f"{CLOSE}\n"))).withColumn("own", own)
    key = ["conv_id", "part_no", "speaker"]
    before = Window.partitionBy(*key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    grouped = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "segment", "head", "own"))).alias("parts"))
    span: Column = F.transform(F.filter("parts", lambda x: x["own"]), lambda x: F.struct((x["start"] + x["head"]).alias("start"), (x["start"] + F.length(x["segment"]) - 1).alias("end")))
    return grouped.select(*key, F.size("parts").cast("long").alias("n_turns"), F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("dialogue"), span.alias("spans"))


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rotate(read(spark, sf_dir, "conversations")).withColumn("spans", spans)


ORACLE = rf"""
with t as (
  select conv_id, coalesce(floor(turn / 1024.0) - (turn < 0)::int, -1)::bigint as part_no, turn, coalesce(role, 'unknown') as role,
    replace(coalesce(text, ''), '<|', '< |') as text,
    replace(regexp_replace(coalesce(role, 'unknown'), '[\x00-\x1F\x7F\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g'), '<|', '< |') as name
  from conversations),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
r as (
  select t.conv_id, t.part_no, s.speaker, t.turn, t.role, t.text, t.role = s.speaker as own,
    case when t.role = s.speaker then '{OPEN}assistant' || chr(10) when t.role = 'system' then '{OPEN}system' || chr(10)
      else '{OPEN}user name=' || t.name || chr(10) end as head
  from t join s on t.conv_id is not distinct from s.conv_id),
g as (select *, head || text || '{CLOSE}' || chr(10) as segment from r),
p as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, part_no, speaker order by turn, role, text rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from g)
select conv_id, part_no, speaker, count(*) as n_turns, string_agg(segment, '' order by start) as dialogue,
  coalesce(string_agg(case when own then (start + length(head))::varchar || '-' || (start + length(segment) - 1)::varchar end, ',' order by start), '') as spans
from p group by conv_id, part_no, speaker"""
