"""Validation of moves against the table constraints, and key assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import tile_of
from tessera.schema import COORD_MAX, COORD_MIN
from tessera.scratch import lookup_table

CELL = ["board_id", "x", "y"]


def constraint_reason() -> Column:
    """First row-level constraint a move breaks, or NULL.  NULL coordinates pass."""
    outside = [~F.col(c).between(COORD_MIN, COORD_MAX) for c in ("x", "y")]
    return F.when(F.coalesce(outside[0], F.lit(False)), F.lit("out_of_range")).when(
        F.coalesce(outside[1], F.lit(False)), F.lit("out_of_range")
    ).when(F.col("uid").isNull(), F.lit("null_owner"))


def check_stones(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add ``reason``: NULL if accepted, else out_of_range, null_owner or occupied.

    The first writer of a cell (smallest ``id``) wins; cells of ``existing`` are
    taken already.  Winners come from one map-side combined aggregate per cell and
    are matched back on the unique ``(board_id, id)``, so a cell that attracts a
    large share of all attempts never gathers in one task.
    """
    rule = df.withColumn("_rule", constraint_reason())
    placed = rule.filter(F.col("_rule").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    winners = placed.groupBy(*CELL).agg(F.min("id").alias("id"))
    if existing is not None:
        winners = winners.join(existing.select(*CELL), CELL, "left_anti")
    winners = winners.select("board_id", "id", F.lit(True).alias("_won"))
    loose = F.col("x").isNull() | F.col("y").isNull()
    return (
        rule.join(winners, ["board_id", "id"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_rule").isNotNull(), F.col("_rule")).when(
                ~(F.coalesce("_won", F.lit(False)) | loose), F.lit("occupied")
            ),
        )
        .drop("_rule", "_won")
        .select(*df.columns, "reason")
    )


def first_writers(df: DataFrame) -> DataFrame:
    """Just the accepted rows of ``check_stones`` for a capture-free load, in one shuffle:
    the first writer of each cell, and every row with a NULL coordinate."""
    rest = [c for c in df.columns if c not in CELL and c != "id"]
    ok = df.filter(constraint_reason().isNull())
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    best = ok.filter(placed).groupBy(*CELL).agg(
        F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in rest]
    )
    return best.select(*df.columns).unionByName(ok.filter(~placed))


def assign_ids(df: DataFrame, order: str, out: str = "id", fan: int = 65536) -> DataFrame:
    """Add ``out`` = arrival rank within the board, 1 for the smallest ``order``.

    ``order`` is a whole number, unique per board.  Rows are ranked inside runs of
    ``fan`` consecutive values and shifted by the rows before the run.  That shift
    is summed up level by level, each level grouping ``fan`` runs of the one below,
    so no window holds more than ``fan`` rows whatever the size of a board.
    """
    depth = 1
    while fan**depth < 2**63:
        depth += 1
    steps = [f"_b{i}" for i in range(1, depth)]
    cut = df
    for i, b in enumerate(steps):
        below = F.col(steps[i - 1] if i else order)
        cut = cut.withColumn(b, tile_of(below, fan, centred=False))
    shift, counts = None, cut.groupBy("board_id", *steps).agg(F.count(F.lit(1)).alias("_n"))
    for i, b in enumerate(steps):
        above = steps[i + 1 :]
        earlier = (
            Window.partitionBy("board_id", *above)
            .orderBy(b)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = counts.select(
            "board_id", b, *above, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s")
        )
        if shift is None:
            shift = level
        else:
            shift = shift.join(
                level.withColumnRenamed("_s", "_more"), ["board_id", b, *above]
            ).withColumn("_s", F.col("_s") + F.col("_more")).drop("_more")
        if above:
            counts = counts.groupBy("board_id", *above).agg(F.sum("_n").alias("_n"))
    inside = Window.partitionBy("board_id", steps[0]).orderBy(order)
    return (
        cut.withColumn("_r", F.row_number().over(inside))
        .join(shift.select("board_id", steps[0], "_s"), ["board_id", steps[0]])
        .withColumn(out, (F.col("_s") + F.col("_r")).cast("long"))
        .drop(*steps, "_r", "_s")
    )


def next_bid(stones: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Per board the next free block label: ``max(bid) + 1``, 1 on an empty board."""
    top = stones.groupBy("board_id").agg(F.max("bid").alias("_m"))
    if boards is not None:
        top = boards.select("board_id").distinct().join(top, "board_id", "left")
    return top.select("board_id", (F.coalesce("_m", F.lit(0)) + 1).cast("long").alias("next_bid"))


def assign_labels(df: DataFrame, stones: DataFrame, order: str = "id") -> DataFrame:
    """Add fresh ``bid`` labels to a batch: the board's next label, then upwards."""
    ranked = assign_ids(df, order, out="_rank")
    base = lookup_table(next_bid(stones, df), "next-labels")
    return (
        ranked.join(base, "board_id")
        .withColumn("bid", F.col("next_bid") + F.col("_rank") - 1)
        .drop("_rank", "next_bid")
    )
