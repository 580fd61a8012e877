"""Chat formatting by perspective rotation.

Every participant of a conversation is in turn the assistant: its turns are rendered as the assistant's
and trained on, everybody else's as a named user's and masked out. System turns stay system turns in
every rendering and are no participant. A rendering is kept as its segments, one row a turn, so that a
conversation of any length is never gathered in one task; ``assemble`` joins the segments of short ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of control characters and line separators, which a name in a header must not have.
BREAKS = "[\\x00-\\x1F\\x7F\u0085\u2028\u2029]+"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, train, n_chars: a row for each turn and perspective.

    Participants are a conversation's distinct roles but ``system``; a null role is the participant
    ``unknown`` (a role of that name gets an underscore), a null text is empty. Conversations with system turns alone appear once, with a null
    perspective and nothing to train on. The template's marks inside a text or a
    role are broken up by a space, and line breaks inside a role become one.
    Null conv_ids are one conversation; repeated rows are repeated segments; no rows give no rows.
    """
    role = F.col("role")
    speaker = F.when(role.isNull(), "unknown").when(role.rlike(r"^unknown_*\z"), F.concat(role, F.lit("_"))).otherwise(role)
    said = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.regexp_replace(speaker, BREAKS, " "), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), name.alias("name"), said.alias("said"))
    parts = rows.filter(F.col("speaker") != "system").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    head = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise(F.concat(F.lit("user name="), F.col("name")))
    rendered = F.concat(F.lit(BEGIN), head, F.lit("\n"), F.col("said"), F.lit(END + "\n"))
    return seen.select("conv_id", "perspective", "turn", "speaker", rendered.alias("rendered"), own.alias("train"), F.length("said").cast("long").alias("n_chars"))


def assemble(segments: DataFrame) -> DataFrame:
    """One row a conversation and perspective: the whole rendering and its mask as (start, end) of the trained characters.

    For conversations that fit a task's memory.
    """
    seg = F.struct("turn", "speaker", "rendered", "train", "n_chars")
    per = segments.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    fold = F.expr("""aggregate(segs, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
        (a, s) -> named_struct('at', a.at + length(s.rendered), 'spans', if(s.train, concat(a.spans, array(named_struct(
            'start', a.at + length(s.rendered) - cast(s.n_chars as int) - 11, 'end', a.at + length(s.rendered) - 1))), a.spans)), a -> a.spans)""")
    return per.select("conv_id", "perspective", F.array_join(F.transform("segs", lambda s: s["rendered"]), "").alias("rendered"), fold.alias("mask"))
