"""Preference formatting of conversations, in DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation becomes the prompt and is rendered once; the
turns after it become the two completions, with a loss range over the assistant's words. The result has a row for
each rendered turn, because a conversation has no bound: turns are aligned by their number in one aggregate by
(pair, turn), which combines before its shuffle, and the end of the prefix is a minimum by pair, so no task ever
holds a whole conversation. What is found by conversation or pair, a row each, is written before turns are joined
with it: the join is then not tied to an aggregate's partitions, and a conversation with a large share of all turns can
be split. `assemble()` makes one row for each pair where conversations are known to be short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The marks around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text): pairs from plain dialogues. A conversation as it stands is chosen; rejected is
    the same up to its last assistant turn, where the last assistant turn of its neighbour (conv_id with the last bit
    turned) stands instead. Without that turn in both there is no rejected side. Rows without conv_id or turn belong
    to no conversation and are left out."""
    turns = _turns(conversations).where("conv_id is not null and turn is not null")
    replies = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("reply")).select("conv_id", F.col("reply.turn").alias("at"), F.col("reply.text").alias("said"))
    other = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("said").alias("instead"))
    swap = materialize(replies.join(other, "conv_id").select("conv_id", "at", "instead"), "chat-swaps")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = turns.join(swap, "conv_id").where("turn < at").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    reply = swap.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("instead").alias("text"))
    return chosen.unionByName(before).unionByName(reply)


def format_preferences(sides: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, rendered, loss_begin, loss_end) from (pair_id, side, turn, role, text) with side
    `chosen` or `rejected`: a row for each turn of the prompt, and for each turn of the two completions.

    A turn belongs to the prompt while both sides have it with the same role and text, and so have all turns before
    it. [loss_begin, loss_end) are the characters of `rendered` to train on: an assistant's words and the closing mark
    in a completion, else 0 and 0. A null role is `unknown`, a null text empty. Repeated rows of a turn are one; of
    different ones the first by role and text counts. Sides without the other are all completion; equal sides are
    all prompt. Rows without pair_id or turn are left out. No rows: an empty table. Other columns are not read."""
    cell = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cells = sides.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')").groupBy("pair_id", "turn").agg(F.min(F.when(F.col("side") == "chosen", cell)).alias("chosen"), F.min(F.when(F.col("side") == "rejected", cell)).alias("rejected"))
    ends = cells.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("end"))
    ends = materialize(ends, "chat-ends")
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    one = lambda part, of: F.struct(F.lit(part).alias("part"), F.col(of).alias("cell"))
    parts = F.when(shared, F.array(one("prompt", "chosen"))).otherwise(F.array(one("chosen", "chosen"), one("rejected", "rejected")))
    rows = cells.join(ends, "pair_id", "left").select("pair_id", "turn", F.inline(parts)).where("cell is not null")
    head = F.concat(F.lit(OPEN), F.col("cell.role"), F.lit("\n"))
    rendered = F.concat(head, F.col("cell.text"), F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & (F.col("cell.role") == "assistant")
    return rows.select(
        "pair_id", "part", "turn", F.col("cell.role").alias("role"), rendered.alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).cast("long").alias("loss_begin"), F.when(trained, F.length(rendered)).otherwise(0).cast("long").alias("loss_end"),
    )


def assemble(formatted: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): the rendered turns of each part in one text. For conversations that fit a
    row; format_preferences() has no such bound."""
    text = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "rendered")))), lambda x: x["rendered"]), "")
    return formatted.groupBy("pair_id").agg(*(text(p).alias(p) for p in ("prompt", "chosen", "rejected")))


SQL = """
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null
),
replies as (
  select conv_id, max(turn) as spot, max(text) filter (turn = last) as said
  from (select *, max(turn) over (partition by conv_id) as last from turns where role = 'assistant') group by conv_id
),
swap as (
  select a.conv_id, a.spot, b.said as instead from replies a join replies b on b.conv_id = xor(a.conv_id, 1)
),
sides as (
  select conv_id as pair_id, 'chosen' as side, turn, role, text from turns
  union all
  select t.conv_id, 'rejected', turn, role, text from turns t join swap s on s.conv_id = t.conv_id and t.turn < s.spot
  union all
  select conv_id, 'rejected', spot, 'assistant', instead from swap
),
cells as (
  select pair_id, turn,
         min({'role': role, 'text': text}) filter (side = 'chosen') as chosen,
         min({'role': role, 'text': text}) filter (side = 'rejected') as rejected
  from sides group by pair_id, turn
),
ends as (select pair_id, min(turn) as stop from cells where chosen is distinct from rejected group by pair_id),
parts as (
  select c.pair_id, turn, 'prompt' as part, chosen as cell from cells c left join ends e using (pair_id) where stop is null or turn < stop
  union all
  select c.pair_id, turn, 'chosen', chosen from cells c join ends e using (pair_id) where turn >= stop and chosen is not null
  union all
  select c.pair_id, turn, 'rejected', rejected from cells c join ends e using (pair_id) where turn >= stop and rejected is not null
)
select pair_id, part, turn, cell.role as role,
       '<|im_start|>' || cell.role || chr(10) || cell.text || '<|im_end|>' || chr(10) as rendered,
       cast(case when part <> 'prompt' and cell.role = 'assistant' then 13 + length(cell.role) else 0 end as bigint) as loss_begin,
       cast(case when part <> 'prompt' and cell.role = 'assistant' then 24 + length(cell.role) + length(cell.text) else 0 end as bigint) as loss_end
from parts
"""
