"""Conversations: transcripts, the gate on length, and message lists as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MESSAGES = 4

# Turns per transcript part; a longer conversation continues in the next part.
PART_TURNS = 1_000


def transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``ROLE: content`` blocks joined by blank lines, in turn order.

    A part covers a fixed range of turn numbers (which tell the turns of a conversation apart), so one very long conversation spreads over parts
    (joined by blank lines they are the whole) and no task gathers more than a part.
    """
    block = F.concat(F.upper(role), F.lit(": "), F.col(text))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(turn), block.alias("block"))))
    part = F.floor(F.col(turn) / part_turns).cast("bigint").alias("part")
    return turns.groupBy(conv, part).agg(
        F.array_join(F.transform(pairs, lambda p: p["block"]), "\n\n").alias("transcript")
    )


def eligible_conversations(turns: DataFrame, conv: str = "conv_id", force: bool = False) -> DataFrame:
    """Turns of the conversations that have at least four messages; all of them when forced.

    Counts combine map-side; the turns meet the counts by a semi join, which adaptive execution
    splits where one conversation dominates.
    """
    if force:
        return turns
    long_enough = turns.groupBy(conv).agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_MESSAGES)
    return turns.join(long_enough.select(conv), conv, "left_semi")


def build_messages(turns: DataFrame, system: str, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text", dedupe: bool = True) -> DataFrame:
    """The messages of a call, as rows ordered by (conv, position).

    First the system text, then the history in turn order. ``dedupe=False`` sends the last user
    turn a second time at the end, as a call does that appends it to a history holding it already.
    """
    by_conv = turns.groupBy(conv)
    latest_user = F.when(F.col(role) == "user", F.col(turn))
    bounds = by_conv.agg(
        F.max(turn).alias("_last"),
        F.max_by(F.when(F.col(role) == "user", F.col(text)), latest_user).alias("_user"),
    )
    history = turns.select(conv, (F.col(turn) + 1).cast("bigint").alias("position"), F.col(role).alias("role"), F.col(text).alias("content"))
    lead = turns.select(conv).distinct().select(
        conv, F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("role"), F.lit(system).alias("content")
    )
    rows = lead.unionByName(history)
    if dedupe:
        return rows
    repeated = bounds.where(F.col("_user").isNotNull()).select(
        conv, (F.col("_last") + 2).cast("bigint").alias("position"), F.lit("user").alias("role"), F.col("_user").alias("content")
    )
    return rows.unionByName(repeated)
