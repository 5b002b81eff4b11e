"""Chat transcripts as ordered turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_window(turns: DataFrame, n: int = 6) -> DataFrame:
    """The first and the last ``n - 1`` turns of each conversation longer than ``n``.

    The cut-off turn comes from a partial aggregate that keeps only the ``n - 1``
    largest turn numbers, so a conversation of any length is never gathered.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        turns.select("conv_id", "turn")
        .withColumn("rank", F.row_number().over(latest))
        .where(F.col("rank") <= n - 1)
        .groupBy("conv_id")
        .agg(F.min("turn").alias("from_turn"))
    )
    opening = turns.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turns"))
    bounds = opening.join(recent, "conv_id")
    keep = (F.col("turns") <= n) | (F.col("turn") == F.col("first_turn")) | (F.col("turn") >= F.col("from_turn"))
    return turns.join(bounds, "conv_id").where(keep).select(*turns.columns)


def valid_conversations(turns: DataFrame) -> DataFrame:
    """User and assistant turns of the conversations that open with the user."""
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    opener = spoken.groupBy("conv_id").agg(F.min_by("role", "turn").alias("opener"))
    good = opener.where(F.col("opener") == "user").select("conv_id")
    return spoken.join(good, "conv_id", "left_semi")
