"""Preference formatting: chosen and rejected conversations become prompt, paired completions and loss masks.

All of it is DataFrame functions. Turns that both sides share from the start are the prompt, rendered once; what
follows on each side is its completion. A mask lists the character ranges of a completion on which to train: the
assistants' text with its end mark, not role heads and not other roles.

A turn renders as ``<|role|>``, line feed, text, ``<|end|>``, line feed. ``<|`` inside role or text is written ``< |``, so
text cannot fake a mark. Null text is empty, a null role is ``unknown``. Turns sort by (turn, role, text), nulls first;
repeated turns stay. Turns without conversation id take no part. If one side is a prefix of the other, its
completion is empty; of equal sides both are. An empty table gives no rows. A pair is one output row,
so its turns meet in one row by contract; nothing else is gathered, and equal conversations or first turns share no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry

TRAINED_ROLE = "assistant"
HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``pair_id`` and ``turns``, its (role, text) in order, cleaned of nulls and marks."""
    rows = turns.select(
        turns[id_col].alias("pair_id"), F.struct(turns["turn"].alias("turn"), turns["role"].alias("role"), turns["text"].alias("text")).alias("t")
    ).where("pair_id is not null")
    ordered = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select(
        "pair_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                _safe(F.coalesce(t["role"], F.lit("unknown"))).alias("role"), _safe(F.coalesce(t["text"], F.lit(""))).alias("text")
            ),
        ).alias("turns"),
    )


def stale_reply_pairs(convs: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, ``chosen`` (the conversation) and ``rejected``: its last reply replaced by its first, or by nothing if it has one."""
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k)["role"] == role)
    with_ends = convs.withColumn("first", F.array_min(replies)).withColumn("last", F.array_max(replies))
    stale = F.when(F.col("first") < F.col("last"), F.element_at("turns", F.col("first"))["text"]).otherwise(F.lit(""))
    return with_ends.select(
        "pair_id", F.col("turns").alias("chosen"),
        F.transform(
            "turns",
            lambda t, k: F.when(k + 1 == F.col("last"), F.struct(t["role"].alias("role"), stale.alias("text"))).otherwise(t),
        ).alias("rejected"),
    )


def common_turns(left: str, right: str) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(left), F.size(right))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda k: ~F.element_at(left, k).eqNullSafe(F.element_at(right, k)))
    return F.when(shorter <= 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, shorter))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(TAIL), t["text"], F.lit(END))), "")


def loss_mask(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """``start:end`` of every trained range of the rendered turns, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + len(HEAD + TAIL) + F.length(t["role"])
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", start.cast("string"), (end - 1).cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add, lambda state: F.array_join(state["spans"], ","))


def format_preferences(pairs: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, ``chosen`` and ``rejected`` (arrays of (role, text)) become prompt, completions and masks."""
    cut = pairs.withColumn("shared", common_turns("chosen", "rejected"))
    rest = {side: F.slice(side, F.col("shared") + 1, F.size(side)) for side in ("chosen", "rejected")}
    return cut.select(
        "pair_id", F.col("shared").cast("bigint").alias("prompt_turns"),
        rendered(F.slice("chosen", F.lit(1), F.col("shared"))).alias("prompt"),
        *[rendered(rest[side]).alias(side) for side in rest],
        *[loss_mask(rest[side], role).alias(f"{side}_mask") for side in rest],
    )


SQL = """
with t as (select conv_id, turn, coalesce(replace(role, '<|', '< |'), 'unknown') r, coalesce(replace(text, '<|', '< |'), '') x,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) n
  from conversations where conv_id is not null),
e as (select conv_id, min(n) filter (r = 'assistant') a, max(n) filter (r = 'assistant') z, max(n) m from t group by 1),
s as (select t.*, e.z, e.m, case when n <> z or z is null then x when a < z then (select x from t f where f.conv_id = t.conv_id and f.n = e.a) else '' end y
  from t join e using (conv_id)),
p as (select conv_id, coalesce(min(n) filter (x <> y) - 1, max(n)) shared from s group by 1),
w as (select s.conv_id, n, shared, r, n > shared as tail, '<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) cx,
    '<|' || r || '|>' || chr(10) || y || '<|end|>' || chr(10) cy from s join p using (conv_id)),
o as (select *, coalesce(sum(length(cx)) over (partition by conv_id, tail order by n rows between unbounded preceding and 1 preceding), 0) ox,
    coalesce(sum(length(cy)) over (partition by conv_id, tail order by n rows between unbounded preceding and 1 preceding), 0) oy from w)
select conv_id pair_id, any_value(shared)::bigint prompt_turns,
  coalesce(string_agg(cx, '' order by n) filter (not tail), '') prompt,
  coalesce(string_agg(cx, '' order by n) filter (tail), '') chosen,
  coalesce(string_agg(cy, '' order by n) filter (tail), '') rejected,
  coalesce(string_agg((ox + length(r) + 5)::bigint || ':' || (ox + length(cx) - 1)::bigint, ',' order by n) filter (tail and r = 'assistant'), '') chosen_mask,
  coalesce(string_agg((oy + length(r) + 5)::bigint || ':' || (oy + length(cy) - 1)::bigint, ',' order by n) filter (tail and r = 'assistant'), '') rejected_mask
from o group by 1
"""


@registry.query("op9_chat_format", SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a stale last reply, formatted for preference training."""
    return format_preferences(stale_reply_pairs(conversations(registry.table(spark, sf_dir, "conversations"))))
