"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and the others
as named users; the masks say which characters the assistant wrote, its end marker included. Roles in `context_roles`
(the system prompt) are shown to everybody and never speak as the assistant.

A conversation is rendered in parts of `part_turns` messages, so that one with a third of all rows is many rows of many
tasks: its messages are range-partitioned and sorted by (conversation, turn), numbered by their place in the partition
plus what the partitions before hold, and grouped by (conversation, part). Only counts by (conversation, partition) meet
in a window. The texts of the parts in order, joined, are the whole rendering.

Defined cases: null text is an empty message; a null role is the participant `unknown`; a null conversation id is a
conversation of its own; null turns come first; equal turns are ordered by role, then text; equal rows are messages each;
`<|` in a name or text becomes `< |`, so nothing in the data looks like a marker; conversations of context roles alone
have no participant and give no rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import staged

UNKNOWN = "unknown"


def _safe(column):
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, nr (0 for the first message of its conversation), name, text of (conv_id, turn, name, text) rows."""
    order = ["conv_id", "turn", "name", "text"]
    placed = turns.withColumn("mix", F.xxhash64("name", "text")).repartitionByRange("conv_id", "turn", "name", "mix")
    # Equal (conversation, turn, name) may lie in several partitions, by hash; their order among themselves follows it.
    placed = staged(placed.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "name", "mix", "text").select(
        *order, F.monotonically_increasing_id().alias("at")), "turns")
    placed = placed.withColumn("partition", F.shiftright("at", 33))
    starts = placed.groupBy("conv_id", "partition").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("conv_id").alias("s_conv"), F.col("partition").alias("s_part"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(starts, F.expr("conv_id <=> s_conv and partition = s_part")).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("nr"), "name", "text")


def perspectives(
    turns: DataFrame, part_turns: int = 64, context_roles: tuple[str, ...] = ("system",), conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, participant, part, n_messages, text, masks (start, stop; code points of text) of each part."""
    wanted = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        _safe(F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN))).alias("name"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    parts = numbered(wanted).groupBy("conv_id", F.floor(F.col("nr") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("nr", "name", "text"))).alias("m"))
    context = F.array(*map(F.lit, context_roles)).cast("array<string>")
    speakers = wanted.where(~F.array_contains(context, F.col("name"))).groupBy("conv_id", "name").agg(
        F.count("*").alias("n")).select(F.col("conv_id").alias("p_conv"), F.col("name").alias("participant"))
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("p_conv")))
    names = ", ".join("'" + r.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in context_roles)
    is_context = f"array_contains(array({names}), x.name)" if names else "false"
    head = f"concat('<|', case when {is_context} then x.name when x.name = participant then 'assistant' else concat('user:', x.name) end, '|>\\n')"
    views = views.withColumn("pieces", F.expr(
        f"transform(m, x -> named_struct('head', {head}, 'body', concat(x.text, '<|end|>'), 'mine', x.name = participant and not {is_context}))"))
    # Characters before each piece; a part has part_turns pieces at most.
    step = "length(x.head) + length(x.body) + 1"
    views = views.withColumn("ends", F.expr(
        f"aggregate(pieces, cast(array(0) as array<int>), (a, x) -> array_append(a, element_at(a, -1) + {step}))"))
    return views.select(
        "conv_id", "participant", "part", F.size("m").cast("long").alias("n_messages"),
        F.expr("array_join(transform(pieces, x -> concat(x.head, x.body, '\\n')), '')").alias("text"),
        F.expr("transform(filter(transform(pieces, (x, i) -> named_struct('mine', x.mine, 'start', ends[i] + length(x.head), "
               "'stop', ends[i + 1] - 1)), x -> x.mine), x -> named_struct('start', x.start, 'stop', x.stop))").alias("masks"))
