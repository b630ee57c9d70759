"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users. The rendering is a row for each message: its segment
of the text, where the segment starts, and the span that a model is trained on. A
conversation of any length is so never gathered in one row or task; joined in the order of
``position``, the segments of a perspective are its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.joins import lookup_join, running_totals

# Roles that set the scene: shown in every perspective, never a participant.
SETTING = ("system",)
UNNAMED = "unknown"

# Fixed text of the format.
ASSISTANT = "<|assistant|>\n"
SETTING_HEAD = "<|{role}|>\n"
USER_HEAD = "<|user name={role}|>\n"
END = "<|end|>\n"


def _head(pattern: str, role: Column) -> Column:
    before, after = pattern.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def rotate_perspectives(messages: DataFrame, setting: Sequence[str] = SETTING) -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, trained, segment, start, mask_start, mask_end).

    ``messages`` has conv_id, turn, role and text. A segment is a header, the text and an end mark.
    ``start`` counts the characters of earlier segments of the perspective; for the
    perspective's own messages (``trained``) mask_start and mask_end span text and end mark,
    for others they are null. ``position`` counts from 1 in the order of (turn, role, text), nulls
    first; equal rows follow one another. A null text is empty; a message without a role is by
    a user named ``unknown`` and no perspective of its own, as are the ``setting`` roles. Messages
    without a conv_id are one conversation. A conversation without participants gives no
    rows, as does an empty table. Other columns are ignored.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # a null conversation is a key like any other
    key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    rows = rows.withColumn("conv", key).drop("conv_id")
    scene = F.col("role").isin(*setting) if setting else F.lit(False)
    parties = rows.filter(F.col("role").isNotNull() & ~scene).select("conv", F.col("role").alias("perspective")).distinct()
    views = lookup_join(rows, parties, "conv")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    name = F.coalesce("role", F.lit(UNNAMED))
    head = F.when(own, F.lit(ASSISTANT)).when(scene, _head(SETTING_HEAD, name)).otherwise(_head(USER_HEAD, name))
    views = views.select(
        "conv", "perspective", "turn", "role", "text", own.alias("trained"), head.alias("head"),
        (F.length(head) + F.length("text") + len(END)).cast("long").alias("size"), F.lit(1).cast("long").alias("one"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = running_totals(views, {"start": "size", "before": "one"}, order, ["conv", "perspective"])
    body = F.col("start") + F.length("head")
    return placed.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), "perspective", (F.col("before") + 1).alias("position"), "turn",
        F.when(F.col("trained"), F.lit("assistant")).otherwise(F.coalesce("role", F.lit(UNNAMED))).alias("speaker"), "trained",
        F.concat("head", "text", F.lit(END)).alias("segment"), "start",
        F.when(F.col("trained"), body).alias("mask_start"), F.when(F.col("trained"), F.col("start") + F.col("size")).alias("mask_end"),
    )
