"""Perspective rotation of multi-party dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that share a part, and turns of a part that share a piece; it bounds what a group holds.
PART_TURNS = 256
#: Turns before a part that stand at its head, so that what is trained on has its context.
HISTORY_TURNS = 32
#: Repeats of a turn that one array counts.
_CHUNK = 4096


def _heading(speaker: Column, participant: Column, context: list[str]) -> Column:
    return (
        F.when(speaker.isin(context), F.concat(F.lit("<|"), speaker, F.lit("|>\n")))
        .when(speaker.eqNullSafe(participant), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context: tuple[str, ...] = ("system",),
    part_turns: int = PART_TURNS,
    history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """Each conversation once for each of its participants, who speaks as the assistant there.

    The others become named users; speakers in ``context`` keep their own heading and are nobody's
    perspective. Returns conversation, part, piece, participant, n_turns, n_train, text and spans: the loss
    covers text[start:end] (code points) of each span, that is the participant's own words.

    A row holds at most ``part_turns`` turns: those of one part, ``floor(order / part_turns)``, and where a
    part has more (turns without a number, or of one number), of one piece of it by position. So a
    dialogue of any length is spread over many rows. Turns are in the order of (order, speaker, text). The
    context turns that open a dialogue, as far as its first piece has them, are
    repeated at the head of all its other rows, and after them the last turns of the part before, ``history_turns`` at most, of the numbers
    just before the part's, at the head of its first piece. Neither is counted or trained on: a participant's own words there have no span.

    Nulls: a null conversation is a conversation of its own; a null order makes part -1, which comes first; a null
    speaker is named ``unknown``; a null text is empty. A dialogue without participants gives rows
    whose participant is null. ``<|`` inside a speaker or a text becomes ``< |``. Repeated rows are
    repeated turns; they are counted before the shuffle and repeated when rendered. Further columns
    are left out; an empty table gives no rows.
    """
    safe = lambda c, other: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(other)), F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conversation).alias("_c"),
        F.coalesce(F.floor(F.col(order) / part_turns), F.lit(-1)).cast("long").alias("_part"),
        F.col(order).cast("long").alias("_order"),
        safe(speaker, "unknown").alias("_speaker"),
        safe(text, "").alias("_text"),
    )
    people = rows.where(~F.col("_speaker").isin(list(context))).select(F.col("_c").alias("_k"), F.col("_speaker").alias("participant")).distinct()
    late = F.col("_order") - F.col("_part") * part_turns >= part_turns - history_turns
    last = Window.partitionBy("_c", "_part").orderBy(F.desc("_order"), F.desc("_speaker"), F.desc("_text"))
    history = rows.where(late).withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= history_turns)
    history = history.groupBy("_c", (F.col("_part") + 1).alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_order", "_speaker", "_text"))).alias("_history"))
    history = history.select(F.col("_c").alias("_hc"), F.col("_part").alias("_hp"), "_history")
    counted = rows.groupBy("_c", "_part", "_order", "_speaker", "_text").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_n", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _CHUNK)), lambda i: F.least(F.lit(_CHUNK), F.col("_n") - i * _CHUNK).cast("int"))))
    each = counted.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    nth = F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_order", "_speaker", "_text"))
    parts = (
        each.withColumn("_piece", F.floor((nth - 1) / part_turns))
        .groupBy("_c", "_part", "_piece")
        .agg(F.sort_array(F.collect_list(F.struct("_order", "_speaker", "_text"))).alias("_turns"))
    )
    other = F.array_position(F.transform("_turns", lambda t: t["_speaker"].isin(list(context))), False).cast("int")
    opening = F.slice("_turns", F.lit(1), F.when(other > 0, other - 1).otherwise(F.size("_turns")))
    heads = parts.groupBy("_c").agg(F.min(F.struct("_part", "_piece", opening.alias("turns"))).alias("_first")).select(F.col("_c").alias("_h"), "_first")
    seen = parts.join(heads, F.col("_c").eqNullSafe(F.col("_h")), "left").join(people, F.col("_c").eqNullSafe(F.col("_k")), "left")
    begins = (F.col("_part") == F.col("_first._part")) & (F.col("_piece") == F.col("_first._piece"))
    again = F.when(begins, F.slice("_turns", 1, 0)).otherwise(F.col("_first.turns"))
    said = seen.join(history, F.col("_c").eqNullSafe(F.col("_hc")) & (F.col("_part") == F.col("_hp")) & (F.col("_piece") == 0), "left")

    def line(trained: bool):
        on = lambda t: F.coalesce(t["_speaker"] == F.col("participant"), F.lit(False)) if trained else F.lit(False)
        return lambda t: F.struct(_heading(t["_speaker"], F.col("participant"), list(context)).alias("head"), t["_text"].alias("body"), on(t).alias("on"))

    before = F.concat(again, F.coalesce("_history", F.slice("_turns", 1, 0)))
    lines = F.concat(F.transform(before, line(False)), F.transform("_turns", line(True)))
    size = lambda s: F.length(s["head"]).cast("long") + F.length(s["body"]).cast("long") + 1

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        span = F.struct(begin.alias("start"), (begin + F.length(s["body"])).alias("end"))
        return F.struct((acc["at"] + size(s)).alias("at"), F.when(s["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return said.withColumn("_lines", lines).select(
        F.col("_c").alias(conversation),
        F.col("_part").alias("part"),
        F.col("_piece").cast("long").alias("piece"),
        "participant",
        F.size("_turns").cast("long").alias("n_turns"),
        F.size(F.filter("_lines", lambda s: s["on"])).cast("long").alias("n_train"),
        F.array_join(F.transform("_lines", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("_lines", zero, step, lambda acc: acc["spans"]).alias("spans"),
    )
