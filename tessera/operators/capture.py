"""Captures and suicides: of the last stone, and of many candidate moves."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import adjacent
from tessera.operators.blocks import (
    BLOCK,
    block_sizes,
    dead_related_blocks,
    liberties,
    merge_last,
)
from tessera.operators.ingest import CELL, constraint_reason
from tessera.operators.regions import Split, split_by
from tessera.schema import COORD_MAX, COORD_MIN
from tessera.scratch import Scratch, lookup_table


def capture_last(df: DataFrame) -> Split:
    """Remove the related enemy blocks without liberties, all judged on one state."""
    dead = dead_related_blocks(df).filter("side = 'enemy'")
    return split_by(df, dead.select(*BLOCK), BLOCK)


def suicide_last(df: DataFrame) -> Split:
    """Remove the related own block if it has no liberties; run after captures."""
    dead = dead_related_blocks(df).filter("side = 'own'")
    return split_by(df, dead.select(*BLOCK), BLOCK)


class Settled(NamedTuple):
    """What the last stone of each board leads to, step by step."""

    merged: DataFrame
    captured: DataFrame
    suicided: DataFrame
    final: DataFrame


def settle_last(df: DataFrame, scratch: Scratch | None = None) -> Settled:
    """Merge, capture and suicide for the last stone of every board, in that order.

    Each step reads its input several times, so the states between are written.
    """
    scratch = scratch or Scratch(df.sparkSession)
    merged = scratch.write(merge_last(df), "merged")
    after = capture_last(merged)
    kept = scratch.write(after.kept, "kept")
    end = suicide_last(kept)
    return Settled(merged, after.removed, end.removed, end.kept)


_SLOTS = (1, 2, 3, 4)


def cell_context(stones: DataFrame, cells: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """For each distinct cell with a stone on or next to it: ``taken``, the number of
    occupied ``sides``, and up to four neighbouring blocks.

    Slot ``k`` holds a block's ``_b{k}, _u{k}, _n{k}, _l{k}`` (label, owner, stones,
    liberties); a block met again on another side leaves its later slot NULL.  A
    column ``pinned`` on the stones marks blocks that never lose their last liberty.
    """
    sizes = block_sizes(stones)
    if "pinned" in stones.columns:
        safe = stones.filter("pinned").select(*BLOCK).distinct()
        sizes = sizes.join(safe.withColumn("_safe", F.lit(True)), BLOCK, "left").withColumn(
            "liberties", F.col("liberties") + F.when(F.col("_safe"), 2).otherwise(0)
        ).drop("_safe")
    sizes = lookup_table(sizes, "sizes", scratch)
    # Cells off the board have no neighbours, and stepping from the largest number fails.
    on_board = F.col("x").between(COORD_MIN, COORD_MAX) & F.col("y").between(COORD_MIN, COORD_MAX)
    at = cells.select(*CELL).filter(on_board).distinct()
    steps = at.select(
        "board_id",
        F.col("x").alias("_x"),
        F.col("y").alias("_y"),
        F.posexplode(adjacent(F.col("x"), F.col("y"), 5)).alias("_k", "_c"),
    ).select("board_id", "_x", "_y", "_k", "_c.x", "_c.y")
    met = steps.join(stones.select(*CELL, "bid"), CELL).drop("x", "y").join(sizes, BLOCK)
    parts = {"_b": "bid", "_u": "uid", "_n": "stones", "_l": "liberties"}
    wide = met.groupBy("board_id", "_x", "_y").agg(
        F.max(F.col("_k") == 0).alias("taken"),
        F.count(F.when(F.col("_k") > 0, 1)).alias("sides"),
        *[
            F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"{p}{k}")
            for k in _SLOTS
            for p, c in parts.items()
        ],
    )

    def once(k: int, p: str) -> Column:
        again = F.lit(False)
        for j in range(1, k):
            again = again | F.coalesce(F.col(f"_b{j}") == F.col(f"_b{k}"), F.lit(False))
        return F.when(~again, F.col(f"{p}{k}")).alias(f"{p}{k}")

    return wide.select(
        "board_id",
        F.col("_x").alias("x"),
        F.col("_y").alias("y"),
        "taken",
        "sides",
        *[once(k, p) for k in _SLOTS for p in parts],
    )


def evaluate_moves(
    stones: DataFrame, moves: DataFrame, scratch: Scratch | None = None
) -> DataFrame:
    """Outcome of each candidate move on its own, without playing it.

    A move captures the adjacent enemy blocks whose only liberty is its cell.  It is
    a suicide if it captures nothing, has no empty neighbour and every adjacent own
    block has no other liberty.  Adds ``accepted, captured_blocks, captured_stones,
    suicide, lost_stones`` (own stones a suicide removes, with the move itself) and
    ``merged_bid`` (smallest adjacent own label, NULL if the stone starts a block).
    """
    context = lookup_table(cell_context(stones, moves, scratch), "context", scratch)
    clash = (set(context.columns) - set(CELL)) & set(moves.columns)
    if clash:
        raise ValueError(f"reserved column names in moves: {sorted(clash)}")

    def slot(p: str, k: int) -> Column:
        return F.col(f"{p}{k}")

    def own(k: int) -> Column:
        return F.coalesce(slot("_u", k) == F.col("uid"), F.lit(False))

    def taken(k: int) -> Column:
        return F.coalesce((slot("_u", k) != F.col("uid")) & (slot("_l", k) == 1), F.lit(False))

    def total(test, value) -> Column:
        terms = [F.when(test(k), value(k)).otherwise(0).cast("long") for k in _SLOTS]
        return terms[0] + terms[1] + terms[2] + terms[3]

    judged = (
        moves.join(context, CELL, "left")
        .withColumns(
            {
                "accepted": ~F.coalesce("taken", F.lit(False)) & constraint_reason().isNull(),
                "_blocks": total(taken, lambda k: F.lit(1)),
                "_stones": total(taken, lambda k: slot("_n", k)),
                "_own": total(own, lambda k: slot("_n", k)),
                "_saved": total(own, lambda k: (slot("_l", k) > 1).cast("int")),
                "_label": F.least(*[F.when(own(k), slot("_b", k)) for k in _SLOTS]),
            }
        )
        .withColumn(
            "suicide",
            F.col("accepted")
            & (F.col("_blocks") == 0)
            & (F.coalesce("sides", F.lit(0)) == 4)
            & (F.col("_saved") == 0),
        )
    )
    ok, zero = F.col("accepted"), F.lit(0).cast("long")
    return judged.select(
        *moves.columns,
        "accepted",
        F.when(ok, F.col("_blocks")).otherwise(zero).alias("captured_blocks"),
        F.when(ok, F.col("_stones")).otherwise(zero).alias("captured_stones"),
        "suicide",
        F.when(F.col("suicide"), F.col("_own") + 1).otherwise(zero).alias("lost_stones"),
        F.when(ok, F.col("_label")).alias("merged_bid"),
    )


def captured_blocks(stones: DataFrame, moves: DataFrame) -> DataFrame:
    """``move_id, board_id, bid`` of the blocks each candidate captures.

    ``moves`` must be accepted ones: a block is captured by a move of another owner
    on its only liberty.
    """
    lone = (
        liberties(stones)
        .groupBy(*BLOCK)
        .agg(F.min("uid").alias("_owner"), F.count(F.lit(1)).alias("_n"), F.min("x").alias("x"), F.min("y").alias("y"))
        .filter("_n = 1")
        .drop("_n")
    )
    if "pinned" in stones.columns:
        lone = lone.join(stones.filter("pinned").select(*BLOCK).distinct(), BLOCK, "left_anti")
    return moves.join(lone, CELL).filter("uid != _owner").select("move_id", *BLOCK)
