"""Chat formatting by perspective rotation, on DataFrame operations alone.

A dialogue of several parties is rendered once for each participant: that
speaker's turns become ``assistant`` turns and are trained on (mask 1), the
other speakers become ``user`` turns that begin with the speaker's name, and
``system`` turns stay context for all. The rendering is one row for each turn
with its place in the dialogue's text, so a dialogue of any length is never
gathered into one string by default; :func:`documents` joins them where that
is wanted.

Places need a running sum along a dialogue. Turns are dealt into blocks of
consecutive turn numbers: sums inside a block, then sums over blocks, so one
very long dialogue is many tasks.

Defined cases: a null text is empty; a null role speaks as ``unknown``; a null
turn comes first, ties in a turn are ordered by role and text and repeated
rows follow each other; null conversation ids are one conversation; a
dialogue of system turns alone has no participants and no rows; columns other
than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
BLOCK = 256


def _rendered(role: Column, name: Column, text: Column) -> Column:
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    return F.concat(head, F.when(role == "user", F.concat(name, F.lit(": "))).otherwise(F.lit("")), text, F.lit("\n"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, perspective, position (from 0), speaker, chat_role, content, start, stop, mask.

    ``content`` is the turn as rendered, ``start`` and ``stop`` its characters
    in the whole rendering, ``mask`` 1 if they are trained on.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    # lengths of a turn by the role that it may take: they fix its place in every perspective
    size = F.length("text")
    own, other = F.length(_rendered(F.lit("assistant"), F.lit(""), F.lit(""))), F.length(_rendered(F.lit("user"), F.col("speaker"), F.lit("")))
    fixed = F.length(_rendered(F.lit(SYSTEM), F.lit(""), F.lit("")))
    rows = rows.withColumn("as_other", size + F.when(F.col("speaker") == SYSTEM, fixed).otherwise(other)).withColumn("as_own", size + F.when(F.col("speaker") == SYSTEM, fixed).otherwise(own))
    speakers = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    by_block = rows.groupBy("conv_id", "block", "speaker").agg(F.count("*").alias("n"), F.sum("as_other").alias("other"), F.sum("as_own").alias("own"))
    # each perspective's length of each block, then what stands before the block
    same = F.col("l.speaker") == F.col("s.perspective")
    lengths = (
        by_block.alias("l")
        .join(speakers.alias("s"), F.col("l.conv_id").eqNullSafe(F.col("s.conv_id")))
        .groupBy(F.col("l.conv_id").alias("conv_id"), F.col("s.perspective").alias("perspective"), F.col("l.block").alias("block"))
        .agg(F.sum("l.n").alias("n"), F.sum(F.when(same, F.col("l.own")).otherwise(F.col("l.other"))).alias("chars"))
    )
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select(
        "conv_id", "perspective", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before")
    )
    placed = rows.alias("r").join(before.alias("b"), F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.block") == F.col("b.block")))
    placed = placed.select("r.conv_id", "b.perspective", "r.block", "r.turn", "r.speaker", "r.text", "b.n_before", "b.chars_before")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    placed = placed.withColumn("chat_role", role).withColumn("content", _rendered(F.col("chat_role"), F.col("speaker"), F.col("text")))
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.col("chars_before") + F.sum(F.length("content")).over(order)
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("n_before") + F.row_number().over(order) - 1).cast("long").alias("position"),
        "speaker",
        "chat_role",
        "content",
        (stop - F.length("content")).cast("long").alias("start"),
        stop.cast("long").alias("stop"),
        (F.col("chat_role") == "assistant").cast("int").alias("mask"),
    )


def documents(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text, spans (start, stop of what is trained on): whole dialogues, one row each."""
    parts = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("position", "content", "start", "stop", "mask"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask"] == 1), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return parts.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["content"]), "").alias("text"), spans.alias("spans"))
