"""Named queries: each operator applied to the boards of ``tessera.plans.boards``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.clock import minute_component, minutes_since
from tessera.functions.geometry import neighbours, rect_filter, snap_to_grid, viewport_rect
from tessera.operators import blocks, capture, ingest, last, rects, regions, report
from tessera.plans import boards, stream_queries
from tessera.plans.replay import replay
from tessera.scratch import Scratch
from tessera.sources.snapshot import export_snapshot, load_stones
from tessera.sources.wire import envelope, parse_moves, parse_rect_requests

Query = Callable[[SparkSession, str], DataFrame]
NOW = "timestamp_ntz'2024-03-01 00:00:00'"


def _on_stones(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(boards.stones(spark, sf))


def _on_small(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(boards.small_boards(spark, sf))


def _on_coded(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(boards.coded_stones(spark, sf))


def _labels(tile: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        loaded = ingest.first_writers(boards.placements(spark, sf))
        return blocks.label_blocks(loaded, tile=tile).select("board_id", "id", "bid")

    return run


def _move_status(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_moves(boards.moves_json(spark, sf))
    msg = F.when(F.col("code") == 0, "OK").otherwise("not a move")
    return envelope(parsed.withColumn("msg", msg)).select("board_id", "id", "body")


def _checked_rects(spark: SparkSession, sf: str) -> DataFrame:
    return parse_rect_requests(boards.rect_requests(spark, sf))


def _good_rects(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted requests, parsed once for the several uses that follow."""
    good = _checked_rects(spark, sf).filter("code = 0").drop("code", "msg")
    return Scratch(spark).write(good, "requests")


def _assigned_ids(spark: SparkSession, sf: str) -> DataFrame:
    ev = boards.events(spark, sf).select(F.col("user_id").alias("board_id"), "event_id")
    return ingest.assign_ids(ev, "event_id")


def _assigned_labels(spark: SparkSession, sf: str) -> DataFrame:
    batch = boards.placements(spark, sf).select("board_id", "id")
    return ingest.assign_labels(batch, boards.stones(spark, sf))


def _std_area(spark: SparkSession, sf: str) -> DataFrame:
    stones = boards.stones(spark, sf)
    area = regions.std_area(stones.select("board_id").distinct())
    return area.join(stones.select(*ingest.CELL, "uid"), ingest.CELL, "left")


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    path = export_snapshot(
        boards.small_boards(spark, sf), Scratch(spark).path("export"), boards.SNAPSHOT_TIME
    )
    return load_stones(spark, path)


def _decoded(stones: DataFrame) -> DataFrame:
    rows = {f"row{y}": y for y in (0, 2, 4, 5, 6, 7)}
    return regions.decode_rows(stones, rows)


def _orphans(stones: DataFrame) -> DataFrame:
    alive = blocks.block_table(stones).filter("qi > 0")
    return blocks.orphan_cells(alive, stones.select(*ingest.CELL, "bid"))


def _need_clear(stones: DataFrame) -> DataFrame:
    return blocks.need_clear(stones).withColumn("need", F.col("need").cast("long"))


def _settled(f) -> Query:
    return _on_small(lambda s: f(capture.settle_last(s)))


def _move_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = capture.evaluate_moves(boards.stones(spark, sf), boards.candidates(spark, sf))
    return out.withColumns(
        {c: F.col(c).cast("long") for c in ("accepted", "suicide")}
    )


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks taken by the accepted candidates, one row per move and block."""
    stones = boards.stones(spark, sf)
    moves = boards.candidates(spark, sf).join(stones.select(*ingest.CELL), ingest.CELL, "left_anti")
    named = moves.withColumn("move_id", F.concat_ws(",", "x", "y", "uid"))
    return capture.captured_blocks(stones, named)


def _replay_final(spark: SparkSession, sf: str) -> DataFrame:
    return replay(boards.replay_moves(spark, sf)).final


def _replay_log(spark: SparkSession, sf: str) -> DataFrame:
    log = replay(boards.replay_moves(spark, sf)).log
    return log.withColumn("merged", F.col("merged").cast("long"))


def _replay_on_stones(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of many regions, blocks without liberties among them, are played on."""
    log = replay(boards.late_moves(spark, sf), boards.stones(spark, sf)).log
    return log.withColumn("merged", F.col("merged").cast("long"))


def _region_reset(which: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        stones = boards.stones(spark, sf)
        area = regions.std_area(stones.select("board_id").distinct())
        return getattr(regions.reset_region(stones, area), which)

    return run


def _last_times(spark: SparkSession, sf: str) -> DataFrame:
    return boards.replay_moves(spark, sf).groupBy("board_id").agg(F.max("ts").alias("ts"))


def _minutes(spark: SparkSession, sf: str) -> DataFrame:
    return _last_times(spark, sf).select(
        "board_id", minutes_since(F.col("ts"), F.expr(NOW)).alias("minutes")
    )


def _minute_part(spark: SparkSession, sf: str) -> DataFrame:
    return _last_times(spark, sf).select(
        "board_id", minute_component(F.col("ts"), F.expr(NOW)).alias("minute")
    )


def _view_poll(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in each requested box between the first and the last version of the view."""
    changes = boards.view(spark, sf).changes(1, 3)
    return rects.rects_join(_good_rects(spark, sf), changes)


def _view_at(spark: SparkSession, sf: str) -> DataFrame:
    """The stones and labels as of the second of three versions."""
    return boards.view(spark, sf).stones(2)


QUERIES: dict[str, Query] = {
    # sources, ingest and sinks
    "stones_scan": _on_stones(lambda s: s),
    "moves_parsed": lambda spark, sf: parse_moves(boards.moves_json(spark, sf)),
    "move_status_json": _move_status,
    "rect_requests_checked": _checked_rects,
    "stones_checked": lambda spark, sf: ingest.check_stones(
        boards.damaged_placements(spark, sf)
    ),
    "assigned_ids": _assigned_ids,
    "assigned_labels": _assigned_labels,
    "next_bid": _on_stones(ingest.next_bid),
    "border_cells": _on_stones(
        lambda s: regions.border_block(s).withColumn("taken", F.col("taken").cast("long"))
    ),
    "std_area": _std_area,
    "rect_json": lambda spark, sf: rects.rect_result_json(
        _good_rects(spark, sf), boards.stones(spark, sf)
    ),
    "snapshot_roundtrip": _snapshot,
    # filters, projections, scalar functions
    "neighbour_cells": _on_stones(
        lambda s: neighbours(s.select("board_id", "x", "y"), distinct=True)
    ),
    "rect_stones": _on_stones(lambda s: rect_filter(s, -5, -6, 7, 9)),
    "viewport_rects": lambda spark, sf: viewport_rect(boards.viewports(spark, sf)).select(
        "view_id", "x1", "y1", "x2", "y2"
    ),
    "snapped_points": lambda spark, sf: snap_to_grid(boards.viewports(spark, sf)).select(
        "view_id", "x", "y"
    ),
    "decoded_rows": _on_stones(_decoded),
    # around the last insert
    "last_stone": _on_small(last.last_stone),
    "adjoining_stones": _on_small(last.adjoining),
    "last_open_sides": _on_small(last.open_sides),
    "related_blocks": _on_small(last.related_blocks),
    "related_except_own": _on_small(last.related_except_own),
    "block_table": _on_stones(blocks.block_table),
    "stones_with_block": _on_stones(
        lambda s: blocks.stones_with_block(
            blocks.block_table(s), s.select(*ingest.CELL, "bid")
        )
    ),
    "orphan_cells": _on_stones(_orphans),
    "rect_join_counts": lambda spark, sf: rects.rect_counts(
        _good_rects(spark, sf), boards.stones(spark, sf)
    ),
    "rect_join_counts_small_tiles": lambda spark, sf: rects.rect_counts(
        _good_rects(spark, sf), boards.stones(spark, sf), tile=4
    ),
    "rect_counts_large": lambda spark, sf: rects.rect_counts(
        boards.large_boxes(spark, sf), boards.stones(spark, sf)
    ),
    "rect_json_large": lambda spark, sf: rects.rect_result_json(
        boards.large_boxes(spark, sf), boards.stones(spark, sf)
    ),
    "rect_join_stones": lambda spark, sf: rects.rects_join(
        _good_rects(spark, sf), boards.stones(spark, sf)
    ),
    # blocks, liberties, capture
    "block_neighbours": _on_stones(blocks.block_neighbours),
    "liberty_cells": _on_stones(blocks.liberties),
    "liberty_counts": _on_stones(blocks.liberty_counts),
    "weighted_liberties": _on_stones(blocks.weighted_liberties),
    "dead_related": _settled(lambda r: blocks.dead_related_blocks(r.merged)),
    "need_clear": _settled(lambda r: _need_clear(r.merged)),
    "dead_blocks": _on_stones(blocks.dead_blocks),
    "sweep_removed": _on_stones(lambda s: blocks.sweep(s).removed),
    "sweep_kept": _on_stones(lambda s: blocks.sweep(s).kept),
    "block_labels": _labels(64),
    "block_labels_small_tiles": _labels(8),
    "merged_labels": _on_small(blocks.merge_last),
    "captured_by_last": _settled(lambda r: r.captured),
    "suicide_by_last": _settled(lambda r: r.suicided),
    "settled_boards": _settled(lambda r: r.final),
    "move_outcomes": _move_outcomes,
    "move_captures": _captures,
    "replay_final": _replay_final,
    "replay_log": _replay_log,
    "replay_on_stones_log": _replay_on_stones,
    # region deletes, maintenance, aggregates, time
    "block_by_code_removed": _on_coded(lambda s: regions.delete_block_at_code(s).removed),
    "block_by_code_kept": _on_coded(lambda s: regions.delete_block_at_code(s).kept),
    "rect_by_code_removed": _on_coded(lambda s: regions.delete_rect_by_code(s).removed),
    "rect_by_code_kept": _on_coded(lambda s: regions.delete_rect_by_code(s).kept),
    "region_reset_kept": _region_reset("kept"),
    "region_reset_removed": _region_reset("removed"),
    "square_reset_kept": _on_stones(lambda s: regions.reset_square(s).kept),
    "top_owners": _on_stones(report.top_owners),
    "minutes_since_last": _minutes,
    "minute_component": _minute_part,
    "idle_gaps": lambda spark, sf: report.idle_gaps(boards.replay_moves(spark, sf)),
    "last_move_env": lambda spark, sf: last.last_move_env(boards.replay_moves(spark, sf)),
    "last_owner_setting": lambda spark, sf: last.env_long(
        last.last_move_env(boards.replay_moves(spark, sf)), "last_uid"
    ),
    # kept up to date batch by batch
    "view_stones": lambda spark, sf: boards.view(spark, sf).stones(),
    "view_blocks": lambda spark, sf: boards.view(spark, sf).blocks(),
    "view_stones_before": _view_at,
    "view_poll": _view_poll,
    # streams, run to the end of the available input
    "stream_ingest": stream_queries.ingest_available,
    "stream_idle_sessions": stream_queries.idle_available,
    "stream_rejects": stream_queries.rejects_available,
    "stream_replay_log": stream_queries.replay_available,
    "stream_replay_epochs_log": stream_queries.replay_epochs,
    "stream_replay_final": stream_queries.replay_final,
    "stream_keyed_log": stream_queries.keyed_log,
    "stream_keyed_final": stream_queries.keyed_final,
    "stream_keyed_hot_log": stream_queries.keyed_hot_log,
    "stream_keyed_reset_log": stream_queries.keyed_reset_log,
    "stream_keyed_reset_final": stream_queries.keyed_reset_final,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liberty count per block: which blocks have no way out?"""
    return QUERIES["liberty_counts"](spark, sf_dir)
