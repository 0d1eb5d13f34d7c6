"""Preference formatting of paired conversations.

A pair is two turn lists, chosen and rejected.  Their longest common turn prefix
is rendered once as the prompt; the turns after it are the two completions.
Loss falls on the text and end mark of assistant turns of completions only.

Only DataFrame functions, and rows stay turns: the prefix ends at the smallest
turn where the sides differ, a map-side combined minimum, so a pair of any
length never meets in one row or task.

Defined cases: null role or text is empty; null turns come before all others;
exactly repeated turns of a side count once; several turns of one number are
ordered by role and text; a side without turns leaves the other as its
completion; null pair ids form one pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWEST, with_next


def preference_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Render pairs given as (pair_id, side 'chosen' or 'rejected', turn, role, text).

    One row per rendered turn: pair_id, segment (prompt, chosen, rejected), turn,
    place (among turns of one number), role, rendered, mask_start and mask_chars
    (the trained span of ``rendered`` in code points; 0 and 0 if none).
    """
    t = turns.select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(LOWEST)).alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s)
    both = t.groupBy("pair_id", "turn", "place").agg(pick("chosen"), pick("rejected"))
    both = both.withColumn("differs", ~F.col("chosen").eqNullSafe(F.col("rejected")))
    ends = both.where("differs").groupBy(F.col("pair_id").alias("p")).agg(F.min(F.struct("turn", "place")).alias("fork"))
    cut = both.join(ends, F.col("pair_id").eqNullSafe(F.col("p")), "left").withColumn(
        "common", F.col("fork").isNull() | (F.struct("turn", "place") < F.col("fork")))
    parts = F.when(F.col("common"), F.array(F.struct(F.lit("prompt").alias("segment"), F.col("chosen").alias("t")))) \
        .otherwise(F.array(F.struct(F.lit("chosen").alias("segment"), F.col("chosen").alias("t")),
                           F.struct(F.lit("rejected").alias("segment"), F.col("rejected").alias("t"))))
    rows = cut.select("pair_id", "turn", "place", F.explode(parts).alias("x")).where("x.t is not null") \
        .select("pair_id", "x.segment", "turn", "place", "x.t.role", "x.t.text")
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    body = F.concat(F.col("text"), F.lit("<|end|>\n"))
    trained = (F.col("segment") != "prompt") & (F.col("role") == trained_role)
    return rows.select(
        "pair_id", "segment", "turn", "place", "role", F.concat(head, body).alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).cast("long").alias("mask_start"),
        F.when(trained, F.length(body)).otherwise(0).cast("long").alias("mask_chars"))


def swapped_answers(turns: DataFrame, id_col: str = "conv_id", role: str = "assistant") -> DataFrame:
    """Pairs from plain conversations: the rejected side's last ``role`` turn is the next conversation's.

    The next conversation is the one of next higher id that has a ``role`` turn
    (after the last: the first).  The rejected side ends with the swapped turn; a
    conversation without such a turn is chosen and rejected alike.
    """
    t = turns.select(F.col(id_col).alias("pair_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("_at", F.coalesce(F.col("turn").cast("long"), F.lit(LOWEST)))
    last = t.where(F.col("role") == role).groupBy("pair_id").agg(F.max(F.struct("_at", "text")).alias("l")) \
        .select("pair_id", F.col("l._at").alias("last_at"), F.col("l.text").alias("last_text"))
    swap = with_next(last, "pair_id", "last_text", {"last_text": "swap_text"}) \
        .select(F.col("pair_id").alias("p"), "last_at", "swap_text")
    joined = t.join(swap, F.col("pair_id").eqNullSafe(F.col("p")), "left")
    # of several answers with the last number the greatest text gives way
    kept = joined.where(F.col("last_at").isNull() | (F.col("_at") < F.col("last_at"))).select(
        "pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = swap.select(F.col("p").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last_at").alias("turn"),
                          F.lit(role).alias("role"), F.col("swap_text").alias("text"))
    return t.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text") \
        .unionByName(kept).unionByName(swapped)


def preference_records(rendered: DataFrame, most_turns: int = 1000) -> DataFrame:
    """The training record of every pair of ``preference_turns``: (pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans).

    Texts are the segments' turns in order, the prompt once; spans are the trained
    (start, chars) of a completion in code points.  A side without a turn after the
    prompt is an empty text.  Pairs of more than ``most_turns`` rendered turns stay in
    turn form alone, so no row grows without bound.
    """
    sizes = rendered.groupBy(F.col("pair_id").alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_turns)
    there = rendered.join(sizes, F.col("pair_id").eqNullSafe(F.col("p")))
    turn = F.struct("turn", "place", "rendered", F.col("mask_start").alias("start"), F.col("mask_chars").alias("chars"))
    parts = there.groupBy("pair_id", "segment").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    span = "struct<start:bigint,chars:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def add(so_far, x):
        own = F.array(F.struct((so_far["at"] + x["start"]).alias("start"), x["chars"].alias("chars")))
        more = F.when(x["chars"] > 0, F.concat(so_far["out"], own)).otherwise(so_far["out"])
        return F.struct((so_far["at"] + F.char_length(x["rendered"])).alias("at"), more.alias("out"))

    done = parts.select("pair_id", "segment", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"),
                        F.aggregate("t", zero, add)["out"].alias("spans"))
    one = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    text = lambda s: F.coalesce(one(s, "text"), F.lit("")).alias(s)
    spans = lambda s: F.coalesce(F.max_by("spans", F.when(F.col("segment") == s, 1)), F.array().cast(f"array<{span}>")).alias(f"{s}_spans")
    return done.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))
