"""Square regions, borders, and deletes whose target is coded in the occupancy.

Every delete is a function ``stones -> Split(kept, removed)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ingest import CELL, next_bid
from tessera.schema import BORDER_OWNER, CODE_BITS
from tessera.scratch import lookup_table


class Split(NamedTuple):
    kept: DataFrame
    removed: DataFrame


def split_by(df: DataFrame, hit: DataFrame, keys: list[str]) -> Split:
    """Rows of ``df`` whose keys occur in ``hit`` are removed, the others kept.

    ``hit`` is found first and once, as a written table that both results read.
    """
    hit = lookup_table(hit.select(*keys).distinct(), "hit")
    return Split(df.join(hit, keys, "left_anti"), df.join(hit, keys, "left_semi"))


def _square(boards: DataFrame, lo: int, hi: int) -> DataFrame:
    span = F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
    return boards.select("board_id", F.explode(span).alias("x")).select(
        "board_id", "x", F.explode(span).alias("y")
    )


def make_border(boards: DataFrame, lo: int = -1, hi: int = 19, uid: int = BORDER_OWNER) -> DataFrame:
    """Perimeter cells of a square on every board, all of one owner."""
    edge = F.col("x").isin(lo, hi) | F.col("y").isin(lo, hi)
    return _square(boards, lo, hi).filter(edge).withColumn("uid", F.lit(uid).cast("long"))


def border_block(stones: DataFrame, lo: int = -1, hi: int = 19, uid: int = BORDER_OWNER) -> DataFrame:
    """Border cells of every board with the block label they would get and whether
    the cell is ``taken``; the load is all or nothing, so a taken cell blocks it."""
    border = make_border(next_bid(stones).select("board_id"), lo, hi, uid)
    cells = stones.select(*CELL, F.lit(True).alias("_t"))
    return (
        border.join(cells, CELL, "left")
        .join(next_bid(stones).withColumnRenamed("next_bid", "bid"), "board_id")
        .select(*CELL, "bid", "uid", F.coalesce("_t", F.lit(False)).alias("taken"))
    )


def std_area(boards: DataFrame, lo: int = 0, hi: int = 18) -> DataFrame:
    """All cells of the reserved square region of every board."""
    return _square(boards, lo, hi)


def code_value(row_y: int, x_hi: int = 18, bits: int = CODE_BITS) -> Column:
    """Aggregate: the binary number that one row's occupancy spells, 0 if empty.

    ``x_hi`` is bit 0 and each step to the left the next bit.  Cells are unique, so
    the sum is the bitwise or.
    """
    here = (F.col("y") == row_y) & F.col("x").between(x_hi - bits + 1, x_hi)
    bit = F.when(here, F.expr(f"shiftleft(cast(1 as bigint), cast({x_hi} - x as int))"))
    return F.coalesce(F.sum(bit), F.lit(0)).cast("long")


def decode_rows(df: DataFrame, rows: dict[str, int], x_hi: int = 18, bits: int = CODE_BITS) -> DataFrame:
    """Decode several code rows per board in one scan, e.g. ``{"x": 0, "y": 2}``.

    Only stones of the code rows carry bits, but every board must give a row, so
    the aggregate runs over all stones with map-side combine.
    """
    return df.groupBy("board_id").agg(
        *[code_value(y, x_hi, bits).alias(name) for name, y in rows.items()]
    )


def delete_block_at_code(df: DataFrame, bits: int = CODE_BITS) -> Split:
    """Remove the whole block of the stone at the coded cell (row 0: x, row 2: y)."""
    target = decode_rows(df, {"x": 0, "y": 2}, bits=bits)
    hit = df.join(target, CELL, "left_semi").select("board_id", "bid")
    return split_by(df, hit, ["board_id", "bid"])


def delete_rect_by_code(df: DataFrame, bits: int = CODE_BITS) -> Split:
    """Remove stones in the coded inclusive box (rows 4, 5, 6, 7: x1, y1, x2, y2).

    Empty code rows decode to 0, so they select the cell (0,0); reversed bounds
    select nothing.
    """
    box = lookup_table(decode_rows(df, {"x1": 4, "y1": 5, "x2": 6, "y2": 7}, bits=bits), "box")
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(
        F.col("y1"), F.col("y2")
    )
    tagged = df.join(box, "board_id").withColumn("_in", F.coalesce(inside, F.lit(False)))
    return Split(
        tagged.filter(~F.col("_in")).select(*df.columns),
        tagged.filter("_in").select(*df.columns),
    )


def reset_region(df: DataFrame, area: DataFrame) -> Split:
    """Remove stones whose cell is in ``area`` (``x,y``, or per board with
    ``board_id``).  Blocks that are cut keep their label."""
    keys = CELL if "board_id" in area.columns else ["x", "y"]
    return split_by(df, area, keys)


def reset_square(df: DataFrame, lo: int = 0, hi: int = 18) -> Split:
    """``reset_region`` for the reserved square, as a pushed-down range filter."""
    inside = F.coalesce(F.col("x").between(lo, hi) & F.col("y").between(lo, hi), F.lit(False))
    return Split(df.filter(~inside), df.filter(inside))
