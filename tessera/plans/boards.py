"""Boards, moves and requests derived from the shared test tables.

Each function takes ``(spark, sf_dir)``.  Numbers of boards and rows follow the
tables, so density and board size do not depend on the scale factor.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import neighbours
from tessera.operators.blocks import label_blocks
from tessera.operators.ingest import first_writers
from tessera.operators.last import last_stone
from tessera.operators.maintained import BlockView
from tessera.operators.regions import decode_rows
from tessera.schema import EVENTS
from tessera.scratch import Scratch
from tessera.sources.snapshot import export_snapshot, load_stones

SNAPSHOT_TIME = dt.datetime(2024, 1, 1, 6, 0, 0)
_WRITTEN: dict[tuple[str, str, str], str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    files = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet")
    return files.parquet(sf_dir)


def _spread(prime: int = 1000003) -> Column:
    """Pseudo-random number of an event; terms are reduced first to stay in range."""
    e = F.col("event_id") % prime
    return (e * e * 31 + e * 7919 + (F.col("user_id") % prime) * 104729) % prime


def _grid(size: int, shift: int) -> tuple[Column, Column]:
    h = F.col("_h")
    return (h % size) - shift, (F.floor(h / size).cast("long") % size) - shift


def _moves(ev: DataFrame, board: Column, uid: Column, size: int, shift: int = 0) -> DataFrame:
    x, y = _grid(size, shift)
    return ev.withColumn("_h", _spread()).select(
        board.cast("long").alias("board_id"),
        F.col("event_id").alias("id"),
        x.alias("x"),
        y.alias("y"),
        uid.cast("long").alias("uid"),
        "ts",
    )


def _per(width: int) -> Column:
    return F.floor(F.col("event_id") / width).cast("long")


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempted stones on 38 x 38 boards, one board per 1000 events, 4 owners."""
    return placements_of(events(spark, sf_dir))


def placements_of(ev: DataFrame) -> DataFrame:
    return _moves(ev, _per(1000), F.col("user_id") % 4, 38, 19).drop("ts")


def damaged_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``placements`` with some coordinates out of range and some owners missing."""
    return placements(spark, sf_dir).select(
        "board_id",
        "id",
        F.when(F.col("id") % 97 == 0, F.col("x") + 10019).otherwise(F.col("x")).alias("x"),
        F.when(F.col("id") % 101 == 0, F.col("y") - 10019).otherwise(F.col("y")).alias("y"),
        F.when(F.col("id") % 89 != 0, F.col("uid")).alias("uid"),
    )


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a labelled board set once per application and scan it afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        root = Scratch(spark).path(name)
        _WRITTEN[key] = export_snapshot(build(), root, SNAPSHOT_TIME)
    return load_stones(spark, _WRITTEN[key])


def stones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture-free load of ``placements``, blocks labelled."""
    return _stored(
        spark, sf_dir, "stones", lambda: label_blocks(first_writers(placements(spark, sf_dir)))
    )


def small_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 x 6 boards just after their last insert: the last stone is not merged yet."""

    def build() -> DataFrame:
        ev = events(spark, sf_dir)
        loaded = first_writers(_moves(ev, _per(40), F.col("user_id") % 4, 6).drop("ts"))
        last = last_stone(loaded)
        before = loaded.join(last.select("board_id", "id"), ["board_id", "id"], "left_anti")
        return label_blocks(before).unionByName(last.withColumn("bid", F.col("id")))

    return _stored(spark, sf_dir, "small_boards", build)


def replay_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move logs of one 6 x 6 board per user, two owners."""
    return replay_moves_of(events(spark, sf_dir))


def replay_moves_of(ev: DataFrame) -> DataFrame:
    return _moves(ev, F.col("user_id"), F.col("event_id") % 2, 6)


def zoned_moves_of(ev: DataFrame) -> DataFrame:
    """The same move logs on one board, each in the middle of a walled square of its own."""
    moves = replay_moves_of(ev)
    column, row = F.col("board_id") % 400, F.floor(F.col("board_id") / 400).cast("long")
    return moves.withColumns(
        {"x": column * 20 + 5 + F.col("x"), "y": row * 20 + 5 + F.col("y"), "board_id": F.lit(0).cast("long")}
    )


def view(spark: SparkSession, sf_dir: str) -> BlockView:
    """A view of the blocks of ``placements`` after three batches: each places a third of the
    stones, the later ones also remove some of the batch before."""
    key = (spark.sparkContext.applicationId, sf_dir, "view")
    if key not in _WRITTEN:
        scratch = Scratch(spark)
        made = BlockView(spark, scratch.path("view"), buckets=16)
        loaded = scratch.write(first_writers(placements(spark, sf_dir)), "loaded")
        for k, gone in enumerate(("false", "id % 3 = 0 and id % 7 = 3", "id % 3 = 1 and id % 7 = 5")):
            made.apply(loaded.filter(F.col("id") % 3 == k), loaded.filter(gone))
        _WRITTEN[key] = made.root
    return BlockView(spark, _WRITTEN[key], buckets=16)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell next to a stone, free or not, as a move of owners 0 to 3."""
    cells = neighbours(stones(spark, sf_dir).select("board_id", "x", "y"), distinct=True)
    owners = F.array(*[F.lit(u).cast("long") for u in range(4)])
    return cells.withColumn("uid", F.explode(owners))


def rect_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query strings derived from orders; every 7th one is damaged."""
    boards = events(spark, sf_dir).agg((F.floor(F.max("event_id") / 1000) + 1).cast("long"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    boxes = orders.select(
        k.alias("request_id"),
        (k % boards.scalar()).alias("board_id"),
        (k % 30 - 19).alias("x1"),
        (k % 30 - 17 + c % 8).alias("x2"),
        (F.floor(k / 30).cast("long") % 30 - 19).alias("y1"),
        (F.floor(k / 30).cast("long") % 30 - 17 + F.floor(c / 8).cast("long") % 8).alias("y2"),
    )
    whole = "concat('x1=', x1, '&x2=', x2, '&y1=', y1, '&y2=', y2)"
    damage = (
        "case when request_id % 7 <> 0 then {whole}"
        " else case (request_id div 7) % 8"
        " when 0 then concat('x2=', x2, '&y1=', y1, '&y2=', y2)"
        " when 1 then concat('x1=a', x1, '&x2=', x2, '&y1=', y1, '&y2=', y2)"
        " when 2 then concat('x1=', x1, '&x2=', x1, '&y1=', y1, '&y2=', y2)"
        " when 3 then concat('x1=', x1, '&x2=', x2, '&y1=', y1)"
        " when 4 then concat('x1=', x1, '&x2=', x2, '&y1=', y1, '&y2=1.5')"
        " when 5 then concat('x1=', x1, '&x2=', x2, '&y1=', y2, '&y2=', y1)"
        " when 6 then concat('y2=', y2, '&y1=', y1, '&x2=', x2, '&x1=', x1, '&x1=zz')"
        " else concat('x1=', x1, '&x2=', x2, '&y1=', y1, '&y2=') end end"
    ).format(whole=whole)
    return boxes.select("request_id", "board_id", F.expr(damage).alias("qs"))


def large_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of four shapes derived from customers: wide and thin, tall and thin, large,
    and reaching beyond the board on both sides."""
    boards = events(spark, sf_dir).agg((F.floor(F.max("event_id") / 1000) + 1).cast("long"))
    k, shape = F.col("c_custkey"), F.col("c_custkey") % 4
    row = k % 38 - 19

    def bound(*ways: Column) -> Column:
        return F.when(shape == 0, ways[0]).when(shape == 1, ways[1]).when(shape == 2, ways[2]).otherwise(ways[3])

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("request_id"),
        (k % boards.scalar()).alias("board_id"),
        bound(-600 - k % 9, row, -400 - k % 50, F.lit(-20000)).cast("long").alias("x1"),
        bound(row, -600 - k % 9, -30 - k % 9, row - 40).cast("long").alias("y1"),
        bound(600 + k % 7, row + 1, 400 + k % 30, F.lit(20000)).cast("long").alias("x2"),
        bound(row + 1, 600 + k % 7, 300 + k % 20, row + 40).cast("long").alias("y2"),
    )


def coded_stones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stones`` with more on the far cells that the code rows of each board spell: a pair
    on the coded cell, one on each corner of the coded box, and one outside it."""

    def build() -> DataFrame:
        near = stones(spark, sf_dir).drop("bid")
        code = decode_rows(near, {"cx": 0, "cy": 2, "x1": 4, "y1": 5, "x2": 6, "y2": 7})
        cells = [("cx", "cy"), ("cx + 1", "cy"), ("x1", "y1"), ("x2", "y2"), ("x2 + 1", "y2")]
        far = F.array(*[
            F.struct(F.lit(k).alias("k"), F.expr(x).alias("x"), F.expr(y).alias("y"))
            for k, (x, y) in enumerate(cells)
        ])
        more = code.select("board_id", F.explode(far).alias("c")).select(
            "board_id", (F.lit(10**12) + F.col("board_id") * 10 + F.col("c.k")).alias("id"),
            "c.x", "c.y", F.lit(1).cast("long").alias("uid"),
        )
        return label_blocks(first_writers(near.unionByName(more.filter("x <= 10000 and y <= 10000"))))

    return _stored(spark, sf_dir, "coded_stones", build)


def late_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves derived from customers, to be played on ``stones``."""
    boards = events(spark, sf_dir).agg((F.floor(F.max("event_id") / 1000) + 1).cast("long"))
    k = F.col("c_custkey")
    spread = (k * k * 17 + k * 7919) % 1000003
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        (k % boards.scalar()).alias("board_id"),
        (F.lit(10**9) + k).alias("id"),
        (spread % 38 - 19).alias("x"),
        (F.floor(spread / 38).cast("long") % 38 - 19).alias("y"),
        (F.floor(spread / 1444).cast("long") % 4).alias("uid"),
    )


def moves_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``placements`` rendered as JSON bodies; every 11th one is unusual or damaged."""
    return moves_json_of(events(spark, sf_dir))


def moves_json_of(ev: DataFrame) -> DataFrame:
    body = (
        "case when id % 11 <> 0 then concat('{\"x\":', x, ',\"y\":', y, ',\"uid\":', uid, '}')"
        " else case (id div 11) % 14"
        " when 0 then concat('{\"x\":\"', x, '\",\"y\":', y, ',\"uid\":', uid, '}')"
        " when 1 then concat('{\"x\":', x, '.5,\"y\":', y, ',\"uid\":', uid, '}')"
        " when 2 then concat('{\"x\":', x, ',\"uid\":', uid, '}')"
        " when 3 then concat('oops ', x)"
        " when 4 then 'null'"
        " when 5 then concat('[', x, ',', y, ']')"
        " when 6 then concat('{\"X\":', x, ',\"Y\":', y, ',\"Uid\":', uid, '}')"
        " when 7 then concat('{\"x\":null,\"y\":', y, ',\"uid\":', uid, ',\"z\":\"q\"}')"
        " when 8 then concat('{\"x\":', x, ',\"y\":99999999999999999999,\"uid\":', uid, '}')"
        " when 9 then concat('{\"x\":1e2,\"y\":', y, ',\"uid\":', uid, '}')"
        " when 10 then concat('{\"x\":', x, ',\"y\":', y, ',\"uid\":true}')"
        " when 11 then concat('{\"x\":', x, ',\"y\":', y, ',\"uId\":', uid, '}')"
        " when 12 then concat('{\"X\":', x, ',\"x\":null,\"y\":', y, ',\"UID\":null,\"uiD\":', uid, '}')"
        " else '' end end"
    )
    return placements_of(ev).select("board_id", "id", F.expr(body).alias("body"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel viewports and cursor positions derived from customers."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("view_id"),
        (k % 1000 + 320).alias("width"),
        (k % 700 + 200).alias("height"),
        (k % 640 - 77).alias("begin_x"),
        (k % 480 + 13).alias("begin_y"),
        F.element_at(F.array(*[F.lit(s) for s in (0.25, 0.5, 1.0, 2.0)]), (k % 4 + 1).cast("int")).alias("scale"),
        ((k * 37) % 1320).alias("px"),
        ((k * 53) % 900).alias("py"),
    )
