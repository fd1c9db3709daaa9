"""Column and frame helpers for lattice geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import GRID_PIXELS, TILE

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def adjacent(x: Column, y: Column, n: int = 4) -> Column:
    """Array of the ``n`` cells around ``(x, y)``; 5 includes the cell itself."""
    steps = SIDES if n == 4 else ((0, 0),) + SIDES
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in steps])


def neighbours(df: DataFrame, n: int = 4, distinct: bool = False) -> DataFrame:
    """Replace each row's cell by its 4 edge neighbours (5: and itself).

    Other columns are kept.  ``distinct`` gives set semantics over all columns.
    """
    if n not in (4, 5):
        raise ValueError("n must be 4 or 5")
    keep = [c for c in df.columns if c not in ("x", "y")]
    out = df.select(*keep, F.explode(adjacent(F.col("x"), F.col("y"), n)).alias("_c")).select(
        *keep, "_c.x", "_c.y"
    )
    return out.distinct() if distinct else out


def tile_of(v: Column | str, tile: int = TILE, centred: bool = True) -> Column:
    """Tile index of a coordinate; tile 0 is centred on the origin, or begins there."""
    c = F.col(v) if isinstance(v, str) else v
    moved = (c + F.lit(tile // 2 if centred else 0)).cast("long")
    if tile & (tile - 1) == 0:
        return F.shiftright(moved, tile.bit_length() - 1)
    return F.floor(moved / F.lit(tile)).cast("long")


def tile_offset(v: Column | str, tile: int = TILE) -> Column:
    """Position of a coordinate inside its tile, ``0 .. tile-1``."""
    c = F.col(v) if isinstance(v, str) else v
    return F.pmod(c + F.lit(tile // 2), F.lit(tile))


def rect_filter(df: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Stones inside the inclusive box; requires ``x1 < x2`` and ``y1 < y2``."""
    if not (x1 < x2 and y1 < y2):
        raise ValueError("x1<x2 and y1<y2 required")
    return df.filter(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))


def viewport_rect(
    df: DataFrame,
    width: str = "width",
    height: str = "height",
    begin_x: str = "begin_x",
    begin_y: str = "begin_y",
    scale: str = "scale",
    grid: int = GRID_PIXELS,
) -> DataFrame:
    """Add the grid box ``x1,y1,x2,y2`` that a pixel viewport shows.

    The half size is divided by the scale, the centre is not.  Division by the grid
    truncates toward zero and the box is then widened by one cell on every side.
    """

    def bounds(size: str, begin: str) -> tuple[Column, Column]:
        centre = F.col(size) / F.lit(2.0) - F.col(begin)
        half = F.col(size) / F.col(scale) / F.lit(2.0)
        low = ((centre - half) / F.lit(float(grid))).cast("long") - 1
        high = ((centre + half) / F.lit(float(grid))).cast("long") + 1
        return low, high

    x1, x2 = bounds(width, begin_x)
    y1, y2 = bounds(height, begin_y)
    return df.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def snap_to_grid(
    df: DataFrame,
    px: str = "px",
    py: str = "py",
    begin_x: str = "begin_x",
    begin_y: str = "begin_y",
    scale: str = "scale",
    grid: int = GRID_PIXELS,
) -> DataFrame:
    """Add the cell ``x,y`` nearest to a pixel; halves round up, also below zero."""

    def cell(p: str, begin: str) -> Column:
        v = (F.col(p) - F.col(begin)) / F.col(scale) / F.lit(float(grid))
        return F.floor(v + F.lit(0.5)).cast("long")

    return df.withColumns({"x": cell(px, begin_x), "y": cell(py, begin_y)})
