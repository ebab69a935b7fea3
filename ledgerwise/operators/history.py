"""Bounded conversation history: the newest whole question/reply turns within both limits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policies as P
from ..functions.text import strip

# Messages of one conversation are paired in blocks of this many turn numbers.
TURN_BLOCK = 4096


def json_bytes(text: Column) -> Column:
    """Bytes of the text inside an ASCII-only JSON string, without the quotes."""
    short = F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\f]'))
    escaped = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}]"))
    paired = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return (F.char_length(text) + short + 5 * escaped + 11 * paired).cast("bigint")


# Length of {"role": "user", "content": ""} and of the assistant's.
USER_ENVELOPE = 31
ASSISTANT_ENVELOPE = 36
# Each turn adds its two messages and two ", " separators; the list adds "[]" minus one separator.
TURN_OVERHEAD = USER_ENVELOPE + ASSISTANT_ENVELOPE + 4


def question_turns(messages: DataFrame, size: Column) -> DataFrame:
    """conv_id, turn, bytes of each user message whose next non-system message is a reply.

    The next message is looked up inside blocks of consecutive turn numbers, and for the last one
    of a block at the heads of the following blocks. No task sorts more than one block, or one row
    per block, of a conversation, however long that is.
    """
    df = messages.filter(F.col("role") != "system").select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / TURN_BLOCK).alias("block"),
        F.struct(
            "role", size.alias("bytes"), (strip(F.col("text")) == "").alias("blank")
        ).alias("m"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    df = df.withColumn("next", F.lead("m").over(inside))
    across = Window.partitionBy("conv_id").orderBy("block")
    heads = df.groupBy("conv_id", "block").agg(F.min_by("m", "turn").alias("head"))
    heads = heads.select("conv_id", "block", F.lead("head").over(across).alias("next_head"))
    df = df.join(heads, ["conv_id", "block"]).withColumn("reply", F.coalesce("next", "next_head"))
    paired = (F.col("m.role") == "user") & (F.col("reply.role") == "assistant") & ~F.col("reply.blank")
    return df.filter(paired).select(
        "conv_id", "turn", (F.col("m.bytes") + F.col("reply.bytes")).alias("bytes")
    )


def bounded_history(
    messages: DataFrame,
    max_turns: int = P.MAX_HISTORY_TURNS,
    max_bytes: int = P.MAX_HISTORY_BYTES,
    size: Column | None = None,
    turn_overhead: int = TURN_OVERHEAD,
) -> DataFrame:
    """conv_id, turn, age (1 = newest), running_bytes of the turns kept.

    Dropping the oldest turns until the rest fits leaves the longest suffix that fits. The rank
    filter is applied before the shuffle too, so a conversation sends at most ``max_turns`` rows
    per task.
    """
    turns = question_turns(messages, json_bytes(F.col("text")) if size is None else size)
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = turns.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= max_turns)
    running = F.sum(F.col("bytes") + turn_overhead).over(
        newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return turns.withColumn("running_bytes", running).filter(F.col("running_bytes") <= max_bytes).select(
        "conv_id", "turn", "age", "running_bytes"
    )
