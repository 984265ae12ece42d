"""Chat formatting by perspective: each speaker of a conversation in turn is the assistant.

For every speaker the whole dialogue is rendered with that speaker's messages as the assistant's, the
others' as messages of named users, and system messages as they are. The loss mask covers the
assistant's message and its end mark, nothing else. DataFrame functions only.

Order: messages are dealt out by ranges of (conversation, turn, speaker, text), numbered inside a range
and shifted by the counts of earlier ranges, so a conversation that holds a third of all messages is
many tasks. A rendered dialogue comes in parts of ``part_messages`` messages for the same reason; the
parts' texts, joined in order, are the dialogue.

Defined results: a null role is the speaker with the empty name, a null text is empty, a null turn comes
first, messages of a null conversation form one conversation. Repeated rows are messages of their own.
Ties in turn go by speaker, then text. A conversation of system messages only has no perspective.
Control marks inside a text are broken by a zero-width space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import NO_ID, id_of, query, table
from surfpop.session import cut, number_rows, spread_join

START, END = "<|im_start|>", "<|im_end|>"
BROKEN = "<|​im_"


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation, perspective and message: (_conv, _speaker, _at, _head, _body, _loss)."""
    messages = turns.select(
        id_of(conv_id).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_by"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit(BROKEN)).alias("_body"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["_turn", "_by", "_body", "_tie"]
    laid = cut(messages.repartitionByRange("_conv", *order).withColumn("_block", F.spark_partition_id()))
    numbered = number_rows(laid, ["_conv"], "_block", order, "_at")
    is_system = F.col("_by").isin(*system_roles)
    speakers = laid.where(~is_system).select("_conv", F.col("_by").alias("_speaker")).distinct()
    views = spread_join(numbered, speakers, ["_conv"], ["_at"])
    head = (
        F.when(is_system, F.lit("system"))
        .when(F.col("_by") == F.col("_speaker"), F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.url_encode("_by")))
    )
    return views.select("_conv", "_speaker", "_at", head.alias("_head"), "_body",
                        (~is_system & (F.col("_by") == F.col("_speaker"))).alias("_loss"))


def rendered(head: Column, body: Column) -> Column:
    return F.concat(F.lit(START), head, F.lit("\n"), body, F.lit(f"{END}\n"))


def dialogues(views: DataFrame, part_messages: int = 1000) -> DataFrame:
    """(_conv, _speaker, _part): rendered text, number of messages and loss spans as (start, end) in characters."""
    rows = views.withColumns({
        "_part": F.floor(F.col("_at") / part_messages).cast("bigint"), "_text": rendered(F.col("_head"), F.col("_body")),
        "_lead": F.char_length(F.concat(F.lit(START), "_head", F.lit("\n"))),
    })
    parts = rows.groupBy("_conv", "_speaker", "_part").agg(F.array_sort(F.collect_list(F.struct("_at", "_text", "_lead", "_loss"))).alias("_m"))
    # Running ends of the messages: each adds its length to the last one so far.
    ends = F.aggregate(
        "_m", F.array(F.lit(0)),
        lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(m["_text"]))))
    spans = F.filter(
        F.zip_with("_m", F.slice("_ends", 1, F.size("_m")), lambda m, a: F.struct(
            m["_loss"].alias("loss"), (a + m["_lead"]).alias("start"), (a + F.char_length(m["_text"]) - 1).alias("end"))),
        lambda s: s["loss"])
    return parts.withColumn("_ends", ends).select(
        "_conv", "_speaker", "_part", F.size("_m").cast("bigint").alias("_n"),
        F.array_join(F.transform("_m", lambda m: m["_text"]), "").alias("_text"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("_spans"))


@query("op1_chat_perspectives", """
with m as (
  select conv_id, turn, coalesce(role, '') as who, replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') as body from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, who, body) - 1 as pos from m),
s as (select distinct conv_id, who as speaker from m where who <> 'system'),
v as (
  select n.conv_id, speaker, pos // 1000 as part, pos, who = speaker as loss, body,
         case when who = 'system' then 'system' when who = speaker then 'assistant' else 'user name=' || url_encode(who) end as head
  from n join s on n.conv_id = s.conv_id),
t as (select *, '<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10) as seg from v),
o as (select *, sum(length(seg)) over (partition by conv_id, speaker, part order by pos) - length(seg) as off from t)
select conv_id, speaker, part, count(*) as n_messages, string_agg(seg, '' order by pos) as dialogue,
       coalesce(string_agg(concat(off + length('<|im_start|>' || head || chr(10)), '-', off + length(seg) - 1), ',' order by pos) filter (where loss), '') as loss_spans
from o group by conv_id, speaker, part""")
def op1_chat_perspectives(spark, sf_dir):
    done = dialogues(rotate(table(spark, sf_dir, "conversations")))
    return done.select(
        F.when(F.col("_conv") != NO_ID, F.col("_conv")).alias("conv_id"), F.col("_speaker").alias("speaker"), F.col("_part").alias("part"),
        F.col("_n").alias("n_messages"), F.col("_text").alias("dialogue"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("loss_spans"))
