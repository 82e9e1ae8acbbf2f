"""Preference formatting in DataFrame functions: one prompt, two masked completions.

A preference pair names a chosen and a rejected conversation. Their longest common prefix of
turns (same number, role and text) is the prompt and is rendered once; the turns after it are
the two completions. Only what the assistant says in a completion carries loss. The result is
one row per rendered turn, so no conversation is gathered into one row; ``assemble`` folds the
rows of pairs that are known to be short into texts.

The prefix ends at the first turn number where the two differ or only one has a turn, found
by an aggregation that keeps one number per pair.

Defined results: turns follow their numbers; of repeated rows of a turn the least (role, text)
counts, a null role or text counts as empty, and a turn without a number is no turn. A pair
whose conversations are equal has a prompt and two empty completions, that is no completion
rows. A conversation missing on one side gives the other as completion without a prompt. Other
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import prepare


def neighbours(turns: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side): each even conversation is chosen over the next odd one."""
    return turns.filter("conv_id IS NOT NULL").select("conv_id").distinct().select(
        "conv_id", F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"))


def preference_rows(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered turns: pair_id, segment (prompt, chosen, rejected), turn, role, rendered, loss.

    ``turns``: conv_id, turn, role, text. ``pairs``: conv_id, pair_id, side (chosen or rejected).
    """
    prepare(turns.sparkSession)
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sided = turns.filter("turn IS NOT NULL").join(pairs, "conv_id").groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == "chosen", said)).alias("chosen"),
        F.min(F.when(F.col("side") == "rejected", said)).alias("rejected"))
    apart = sided.groupBy("pair_id").agg(
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))).alias("apart"))
    common = F.col("apart").isNull() | (F.col("turn") < F.col("apart"))
    each = F.when(common, F.array(F.struct(F.lit("prompt").alias("segment"), F.col("chosen").alias("said")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("segment"), F.col("chosen").alias("said")),
                F.struct(F.lit("rejected").alias("segment"), F.col("rejected").alias("said"))))
    return sided.join(apart, "pair_id").select("pair_id", "turn", F.explode(each).alias("x")).filter(
        "x.said IS NOT NULL").select(
        "pair_id", F.col("x.segment").alias("segment"), F.col("turn").cast("long").alias("turn"),
        F.col("x.said.role").alias("role"),
        F.concat(F.lit("<|"), F.col("x.said.role"), F.lit("|>\n"), F.col("x.said.text"), F.lit("\n")).alias("rendered"),
        ((F.col("x.segment") != "prompt") & (F.col("x.said.role") == "assistant")).alias("loss"))


def assemble(rows: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected) texts, for pairs short enough to be one row each."""
    text = lambda name: F.array_join(F.transform(
        F.array_sort(F.filter("turns", lambda t: t["segment"] == name)), lambda t: t["rendered"]), "").alias(name)
    return rows.groupBy("pair_id").agg(F.collect_list(F.struct("turn", "segment", "rendered")).alias("turns")).select(
        "pair_id", text("prompt"), text("chosen"), text("rejected"))
