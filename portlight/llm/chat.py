"""Preference formatting: the common turns of a chosen and a rejected conversation become one prompt, the rest paired completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

TURN = "struct<role:string,text:string>"
SEGMENT_COLUMNS = ["pair_id", "part", "turn", "role", "content", "loss_mask", "n_prompt_turns"]


def rendered(role, text):
    """One turn as text: <|role|>, a line break, the words, <|end|> and a line break."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, turn, role, text of both sides to one row for each rendered turn.

    Turns compare by number, role and text (null equals null). The longest common prefix ends before the smallest turn
    number where the two differ or that only one has. Turns of the prefix appear once, part 'prompt', loss_mask 0; later
    ones appear for each side, part 'chosen' or 'rejected', loss_mask 1 for the assistant's and 0 for others'.
    n_prompt_turns is the number of turns in the prefix. Rows without pair or turn are left out; of repeated turns the
    smallest (role, text) counts; a side without turns is an empty completion. A conversation is never gathered in one
    row: turns meet by pair and turn, so one of any length spreads over the tasks; only the last join is by pair, where Spark can
    split what is skewed. Other columns are ignored.
    """
    sides = chosen.select("pair_id", "turn", F.struct("role", "text").alias("c"), F.lit(None).cast(TURN).alias("r"))
    sides = sides.unionByName(rejected.select("pair_id", "turn", F.lit(None).cast(TURN).alias("c"), F.struct("role", "text").alias("r")))
    # one shuffle brings both sides of a turn together; what follows reads turn numbers alone, and whole texts once more
    both = sides.filter("pair_id is not null and turn is not null").groupBy("pair_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r"))
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    both = materialise(both.withColumn("same", same), "preference-turns")
    turns = both.select("pair_id", "turn", "same")
    ends = turns.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("split_turn"))
    before = F.col("split_turn").isNull() | (F.col("turn") < F.col("split_turn"))
    ends = turns.join(ends, "pair_id").groupBy("pair_id", "split_turn").agg(F.count_if(before).alias("n_prompt_turns"))
    rows = both.join(ends, "pair_id").withColumn("shared", before)
    piece = lambda side, part: F.struct(F.lit(part).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    pieces = F.when(F.col("shared"), F.array(piece("c", "prompt"))).otherwise(
        F.filter(F.array(F.when(F.col("c").isNotNull(), piece("c", "chosen")), F.when(F.col("r").isNotNull(), piece("r", "rejected"))), lambda x: x.isNotNull())
    )
    rows = rows.select("pair_id", "turn", "n_prompt_turns", F.explode(pieces).alias("p"))
    masked = (F.col("p.part") != "prompt") & (F.coalesce(F.col("p.role"), F.lit("")) == "assistant")
    return rows.select(
        "pair_id", F.col("p.part").alias("part"), F.col("turn").cast("long").alias("turn"), F.col("p.role").alias("role"),
        rendered(F.col("p.role"), F.col("p.text")).alias("content"), F.when(masked, 1).otherwise(0).cast("int").alias("loss_mask"), "n_prompt_turns",
    )


def assemble(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected as whole texts. For pairs whose text fits a row; very long ones stay as segments."""
    part = lambda name: F.array_join(
        F.transform(F.array_sort(F.filter(F.collect_list(F.struct("turn", "part", "content")), lambda x: x.part == name)), lambda x: x.content), ""
    )
    return segments.groupBy("pair_id").agg(part("prompt").alias("prompt"), part("chosen").alias("chosen"), part("rejected").alias("rejected"))


def swapped_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A preference pair for each conversation: itself, and itself with its last assistant turn swapped for that of its
    neighbour (conv_id with the lowest bit flipped; without one the turn is left out)."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("pair_id is not null and turn is not null")
    last = rows.filter("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.expr("pair_id ^ 1").alias("pair_id"), F.struct(F.col("last.text").alias("text")).alias("reply"))
    swap = last.select("pair_id", F.col("last.turn").alias("turn")).join(other, "pair_id", "left")
    rejected = rows.join(swap, ["pair_id", "turn"], "left_anti").select("pair_id", "turn", "role", "text")
    new = swap.filter("reply is not null").select("pair_id", "turn", F.lit("assistant").alias("role"), F.col("reply.text").alias("text"))
    return rows, rejected.unionByName(new)


def op2_preference_format(spark, sf_dir: str) -> DataFrame:
    chosen, rejected = swapped_pairs(table(spark, sf_dir, "conversations"))
    return preference_segments(chosen, rejected).select(SEGMENT_COLUMNS)


OP2_SQL = """
with r as (select conv_id as pair_id, turn, role, text from conversations where conv_id is not null and turn is not null),
last as (select pair_id, max(turn) as turn, arg_max(text, (turn, text)) as text from r where role = 'assistant' group by pair_id),
rej0 as (select r.pair_id, r.turn, r.role, r.text from r left join last l on r.pair_id = l.pair_id and r.turn = l.turn where l.pair_id is null
  union all select a.pair_id, a.turn, 'assistant', b.text from last a join last b on b.pair_id = xor(a.pair_id, 1)),
c as (select pair_id, turn, min((role, text)) as v from r group by pair_id, turn),
j as (select pair_id, turn, min((role, text)) as v from rej0 group by pair_id, turn),
b as (select coalesce(c.pair_id, j.pair_id) as pair_id, coalesce(c.turn, j.turn) as turn, c.v as cv, j.v as rv, c.pair_id is not null as hc, j.pair_id is not null as hr
  from c full join j on c.pair_id = j.pair_id and c.turn = j.turn),
s as (select *, hc and hr and cv is not distinct from rv as same from b),
m as (select pair_id, min(case when not same then turn end) as split_turn from s group by pair_id),
t as (select s.*, m.split_turn is null or s.turn < m.split_turn as shared from s join m on s.pair_id = m.pair_id),
n as (select pair_id, count(*) filter (where shared) as n_prompt_turns from t group by pair_id),
p as (select pair_id, turn, 'prompt' as part, cv as v from t where shared
  union all select pair_id, turn, 'chosen', cv from t where not shared and hc
  union all select pair_id, turn, 'rejected', rv from t where not shared and hr)
select p.pair_id, part, cast(turn as bigint) as turn, v[1] as role,
  '<|' || coalesce(v[1], '') || '|>' || chr(10) || coalesce(v[2], '') || '<|end|>' || chr(10) as content,
  cast(case when part <> 'prompt' and v[1] = 'assistant' then 1 else 0 end as integer) as loss_mask,
  cast(n_prompt_turns as bigint) as n_prompt_turns
from p join n on p.pair_id = n.pair_id
"""
