"""Multi-party chats: one rendering of a dialogue per participant, with that speaker as assistant.

A rendering is kept as segments, one row per (perspective, turn), so a dialogue of any length stays spread over
tasks; the text of a rendering is its segments in the order of ``(turn, speaker, text)``.  Every segment carries the part
of it that is trained on: the content and end mark of the assistant's own turns, nothing of others'.

Participants are the distinct speakers of a conversation; ``system`` turns are context for everybody and no
participant.  The few distinct speakers are found by a partial count and looked up per turn; conversations that
hold a large share of all turns are dealt over several tasks for it.

Null texts are empty turns.  A turn without a speaker is rendered for all others as the user ``unknown``, who is not
a participant.  A null conversation id is one conversation of its own.  A conversation without participants has no
rendering.  Repeated rows are repeated segments.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"
# a conversation with at least this many turns is dealt over tasks of about as many turns
SPREAD_TURNS = 64


def participants(turns: DataFrame) -> DataFrame:
    """(conv_id, speakers, turns): distinct speakers of a conversation, sorted, and its number of turns."""
    counted = turns.groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("speaker") != SYSTEM, F.col("speaker"))
    return counted.groupBy("conv_id").agg(F.array_sort(F.collect_set(named)).alias("speakers"), F.sum("n").alias("turns"))


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def rotate(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, name, segment, mask_start, mask_end).

    ``role`` is assistant for the perspective's own turns, system for system turns, else user with ``name``.
    ``mask_start`` and ``mask_end`` bound the trained characters of ``segment`` (equal: nothing is trained).
    """
    turns = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{speaker}`").alias("speaker"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    pieces = F.greatest(F.ceil(F.col("turns") / SPREAD_TURNS), F.lit(1)).cast("int")
    table = participants(turns).select("conv_id", "speakers", pieces.alias("pieces"))
    # a turn draws one of SPREAD_MOST numbers; a conversation of k pieces answers for numbers below k after the modulo
    sizes = table.filter("pieces > 1").select("conv_id", F.col("pieces").alias("cut"))
    dealt = turns.join(sizes, turns["conv_id"].eqNullSafe(sizes["conv_id"]), "left").select(
        turns["*"], F.when(F.col("cut").isNull(), 0).otherwise(F.pmod(F.xxhash64("turn", "speaker", "text"), F.col("cut"))).cast("int").alias("piece")
    )
    copies = table.select(F.col("conv_id").alias("_c"), "speakers", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("_piece"))
    met = dealt.join(copies, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_piece")))
    each = met.select("conv_id", "turn", "speaker", "text", F.explode("speakers").alias("perspective"))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", F.coalesce("speaker", F.lit(UNKNOWN)))
    shaped = each.withColumns({"role": role, "name": name})
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n"))
    whole = F.concat(head, F.col("text"), F.lit(END))
    trained = F.col("role") == "assistant"
    return shaped.select(
        "conv_id", "perspective", "turn", "speaker", "role", "name", whole.alias("segment"),
        F.when(trained, _length(head)).otherwise(F.lit(0).cast("long")).alias("mask_start"),
        F.when(trained, _length(whole)).otherwise(F.lit(0).cast("long")).alias("mask_end"),
    )


def renderings(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_segments, n_chars, n_trained): sizes of the renderings, from partial sums alone."""
    return segments.groupBy("conv_id", "perspective").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(_length(F.col("segment"))).alias("n_chars"), F.sum(F.col("mask_end") - F.col("mask_start")).alias("n_trained"),
    )
