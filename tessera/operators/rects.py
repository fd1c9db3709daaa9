"""Many rectangle requests at once against many boards.

Boxes and stones meet on tiles of the board, never on the board id alone, so a board
or a popular area that holds a large share of the data spreads over many tasks.
Identical boxes are answered once and joined back to their requests.  The width and
the height of tiles are chosen apart, each from levels eight times coarser than the one
before: a box uses those on which it spans at most nine tiles each way, so whatever its
shape it meets few tiles, and its tiles cover at most three times its extent each way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import tile_of
from tessera.operators.ingest import CELL
from tessera.schema import COORD_MAX, COORD_MIN
from tessera.scratch import joined, lookup_table

BOX = ["board_id", "x1", "y1", "x2", "y2"]
STEP = 8
"""Each tile level is this much coarser than the one before."""
FINEST = 8
PART_CELLS = 65536


def _levels(tile: int) -> list[int]:
    """Tile edges, finest first, until one step more would exceed the board."""
    edges = [tile]
    while edges[-1] * STEP < COORD_MAX - COORD_MIN + 1:
        edges.append(edges[-1] * STEP)
    return edges


def _clipped(rects: DataFrame) -> DataFrame:
    """Distinct boxes with the part ``_x1 .. _y2`` that lies on the board; the bounds of a
    request may be any 64-bit numbers, those are safe to calculate with."""
    ends = {
        "_x1": F.greatest(F.col("x1"), F.lit(COORD_MIN)),
        "_y1": F.greatest(F.col("y1"), F.lit(COORD_MIN)),
        "_x2": F.least(F.col("x2"), F.lit(COORD_MAX)),
        "_y2": F.least(F.col("y2"), F.lit(COORD_MAX)),
    }
    return rects.select(*BOX).distinct().withColumns(ends)


def _boxes(rects: DataFrame, tile: int) -> DataFrame:
    """Boxes that meet the board, with the edges ``_ex``, ``_ey`` of their tiles and the
    number ``_lvl`` of that shape."""
    edges = _levels(tile)
    clip = _clipped(rects).filter("_x1 <= _x2 and _y1 <= _y2")

    def pick(extent: Column, values: list[int]) -> Column:
        chosen = F.lit(values[-1])
        for i in reversed(range(len(edges) - 1)):
            chosen = F.when(extent < edges[i] * STEP, values[i]).otherwise(chosen)
        return chosen

    levels = list(range(len(edges)))
    wide, high = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    return clip.withColumns(
        {
            "_lvl": (pick(wide, levels) * len(edges) + pick(high, levels)).cast("int"),
            "_ex": pick(wide, edges).cast("long"),
            "_ey": pick(high, edges).cast("long"),
        }
    )


def _box_tiles(boxes: DataFrame) -> DataFrame:
    """One row per tile a box meets, ``_full`` if it covers the tile."""

    def tile(c: str, e: str) -> Column:
        return F.expr(f"({c} + {e} div 2 - pmod({c} + {e} div 2, {e})) div {e}")

    def covered(t: str, e: str, a: str, b: str) -> Column:
        return F.expr(f"{t} * {e} - {e} div 2 >= {a} and {t} * {e} - {e} div 2 + {e} - 1 <= {b}")

    return (
        boxes.withColumn("_tx", F.explode(F.sequence(tile("_x1", "_ex"), tile("_x2", "_ex"))))
        .withColumn("_ty", F.explode(F.sequence(tile("_y1", "_ey"), tile("_y2", "_ey"))))
        .withColumn("_full", covered("_tx", "_ex", "x1", "x2") & covered("_ty", "_ey", "y1", "y2"))
        .select(*BOX, "_lvl", "_tx", "_ty", "_full")
    )


def _stone_tiles(stones: DataFrame, boxes: DataFrame, tile: int) -> DataFrame:
    """Each stone once per tile shape that some box uses."""
    used = boxes.agg(F.collect_set("_lvl")).scalar()
    edges = _levels(tile)
    shapes = [(i * len(edges) + j, a, b) for i, a in enumerate(edges) for j, b in enumerate(edges)]
    at = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains(used, F.lit(n)),
                    F.struct(
                        F.lit(n).alias("_lvl"), tile_of("x", a).alias("_tx"), tile_of("y", b).alias("_ty")
                    ),
                )
                for n, a, b in shapes
            ]
        )
    )
    keyed = stones.select(*stones.columns, F.explode(at).alias("_t"))
    return keyed.select(*stones.columns, "_t.*")


_TILE_KEY = ["board_id", "_lvl", "_tx", "_ty"]


def _inside() -> Column:
    return F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(
        F.col("y1"), F.col("y2")
    )


def _box_stones(boxes: DataFrame, stones: DataFrame, tile: int) -> DataFrame:
    return (
        joined(_box_tiles(boxes).drop("_full"), _stone_tiles(stones, boxes, tile), _TILE_KEY)
        .filter(_inside())
        .drop("_lvl", "_tx", "_ty")
    )


def rects_join(rects: DataFrame, stones: DataFrame, tile: int = FINEST) -> DataFrame:
    """One row per request and stone inside its inclusive box."""
    hits = _box_stones(_boxes(rects, tile), stones, tile)
    return joined(rects, hits, BOX).select(
        "request_id", *[c for c in stones.columns if c != "board_id"], "board_id"
    )


def rect_counts(rects: DataFrame, stones: DataFrame, tile: int = FINEST) -> DataFrame:
    """``request_id, board_id, stones``: stones in each box, 0 kept.

    Covered tiles add their pre-aggregated count; only tiles on the rim of a box
    are compared stone by stone.
    """
    boxes = _boxes(rects, tile)
    tiles = _box_tiles(boxes)
    keyed = _stone_tiles(stones.select(*CELL), boxes, tile)
    totals = keyed.groupBy(*_TILE_KEY).agg(F.count(F.lit(1)).alias("n"))
    whole = tiles.filter("_full").join(totals, _TILE_KEY).select(*BOX, "n")
    rim = (
        tiles.filter("not _full")
        .join(keyed, _TILE_KEY)
        .filter(_inside())
        .groupBy(*BOX)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_box = lookup_table(
        whole.unionByName(rim).groupBy(*BOX).agg(F.sum("n").alias("n")), "box-counts"
    )
    return rects.join(per_box, BOX, "left").select(
        "request_id", "board_id", F.coalesce("n", F.lit(0)).cast("long").alias("stones")
    )


def rect_result_json(
    rects: DataFrame, stones: DataFrame, part_cells: int = PART_CELLS, tile: int = FINEST
) -> DataFrame:
    """``request_id, part, parts, body``: the stones of each box as JSON arrays of
    ``{x,y,uid}``.

    A box is answered in bands of whole rows, as many as fit ``part_cells`` cells of its
    part on the board.  Every request has its bands ``0 .. parts - 1``, all of them, also
    where no stone lies (``[]``); put together in order of ``part``, their elements are the
    one array of the box, sorted by (y, x).  So no value or task grows with a box, and a
    consumer knows when it has all of an answer.
    """
    # Bands are functions of the box, so they need no table of their own.
    x1, y1 = (F.greatest(F.col(c), F.lit(COORD_MIN)) for c in ("x1", "y1"))
    x2, y2 = (F.least(F.col(c), F.lit(COORD_MAX)) for c in ("x2", "y2"))
    wide, high = (F.greatest(F.lit(1), b - a + 1) for a, b in ((x1, x2), (y1, y2)))
    band = F.greatest(F.lit(1), F.floor(F.lit(part_cells) / wide)).cast("long")
    parts = F.ceil(high / band).cast("long")
    lists = (
        _box_stones(_boxes(rects, tile), stones.select(*CELL, "uid"), tile)
        .withColumn("part", F.floor((F.col("y") - y1) / band).cast("long"))
        .groupBy(*BOX, "part")
        .agg(F.sort_array(F.collect_list(F.struct("y", "x", "uid"))).alias("_s"))
        .select(
            *BOX,
            "part",
            F.to_json(
                F.transform("_s", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["uid"].alias("uid")))
            ).alias("body"),
        )
    )
    bodies = lookup_table(lists, "bodies")
    numbers = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    asked = rects.select("request_id", *BOX, parts.alias("parts"))
    asked = asked.select("*", F.explode(numbers).alias("part"))
    return asked.join(bodies, [*BOX, "part"], "left").select(
        "request_id", "part", "parts", F.coalesce("body", F.lit("[]")).alias("body")
    )
