"""Leaderboard and idle-time reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.clock import whole_seconds
from tessera.schema import IDLE_SECONDS


def top_owners(df: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` owners with the most stones; ties by owner id."""
    return (
        df.groupBy("uid")
        .agg(F.count(F.lit(1)).alias("stones"))
        .orderBy(F.desc("stones"), "uid")
        .limit(n)
    )


def idle_gaps(moves: DataFrame, key: str = "board_id", threshold: int = IDLE_SECONDS) -> DataFrame:
    """Gaps of at least ``threshold`` whole seconds between consecutive moves of a
    key: ``key, id, next_id, idle_from, idle_until, gap`` (epoch seconds).

    Moves are first reduced, by hash aggregates with map-side combine, to one row per
    second and then to the first and last move of each ``threshold``-wide slot.
    Inside a slot no such gap fits, so only neighbouring non-empty slots are
    compared: a hot key costs one row per slot, whatever its number of moves.
    """
    sec = moves.select(key, "id", whole_seconds(F.col("ts")).alias("_s"))
    ticks = sec.groupBy(key, "_s").agg(F.min("id").alias("_a"), F.max("id").alias("_z"))
    slots = ticks.groupBy(key, F.floor(F.col("_s") / F.lit(threshold)).alias("_slot")).agg(
        F.min("_s").alias("_from"),
        F.min_by("_a", "_s").alias("_first"),
        F.max("_s").alias("idle_from"),
        F.max_by("_z", "_s").alias("id"),
    )
    order = Window.partitionBy(key).orderBy("_slot")
    return (
        slots.withColumns(
            {"next_id": F.lead("_first").over(order), "idle_until": F.lead("_from").over(order)}
        )
        .withColumn("gap", F.col("idle_until") - F.col("idle_from"))
        .filter(F.col("gap") >= threshold)
        .select(key, "id", "next_id", "idle_from", "idle_until", "gap")
    )
