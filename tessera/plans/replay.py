"""Ordered replay of move logs: reject, place, merge, capture, suicide.

Every board's moves are played in ``id`` order, yet a board is not one unit of work.
Fill a board with its present stones and the first mover of each other touched cell.
A block of that filling which still has a liberty can never be captured: each of its
stones keeps an empty neighbour until it is joined to that liberty.  Its cells are
*settled*, all their later moves are rejected, and they act as walls.  Only the cells
of the other blocks need the order of play, and their 4-connected regions, divided
by walls, cannot influence each other.  So one set-based pass settles most cells, and
the regions that remain are folded in parallel.

A region without a move keeps its stones, whatever its size.  A region with more than
``fold_limit`` moves, or ten times as many stones, is not folded in one task: its moves
are halved by time and the same pass is applied to each half in turn, which settles
more cells because fewer moves compete.  A single move against an oversized region
is evaluated with joins.  All paths are exact.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import tasks
from tessera.functions.geometry import neighbours
from tessera.operators.blocks import BLOCK, any_of, label_blocks, sides
from tessera.operators.capture import captured_blocks, evaluate_moves
from tessera.operators.ingest import CELL, constraint_reason
from tessera.schema import TILE
from tessera.scratch import Scratch, lookup_table

FOLD_LIMIT = 100_000
STONES_PER_MOVE = 10
"""A task folds up to ``fold_limit`` moves among this many times as many stones."""
_LONG_AGO = -(2**63)
_MOVE = ["board_id", "id"]
_STATE = ["board_id", "id", "x", "y", "uid", "bid", "pinned"]
_RESULT = ["board_id", "id", "x", "y", "uid", "pinned", "outcome", "captured", "merged"]
_FOLD_SCHEMA = (
    "board_id long, id long, x long, y long, uid long, bid long, "
    "kind long, outcome long, captured long, merged boolean"
)


class Replay:
    """``state``: surviving stones with the label they entered with.  ``log``: one
    row per move with ``outcome`` (placed, suicide, or a rejection reason),
    ``captured`` (enemy stones removed) and ``merged`` (it joined an own neighbour).
    ``final``: the surviving stones with the label of their block, found on demand.
    """

    def __init__(self, state: DataFrame, log: DataFrame, labelling: dict):
        self.state = state
        self.log = log
        self._labelling = labelling

    @cached_property
    def final(self) -> DataFrame:
        return label_blocks(self.state, **self._labelling).select(
            "board_id", "id", "x", "y", "bid", "uid"
        )


def replay(
    moves: DataFrame,
    stones: DataFrame | None = None,
    fold_limit: int = FOLD_LIMIT,
    tile: int = TILE,
    scratch: Scratch | None = None,
) -> Replay:
    """Play ``moves`` (``board_id, id, x, y, uid``) on top of ``stones`` (none).

    Move ids are unique per board and above the ids and labels of ``stones``.  A
    block is labelled with the smallest entry label of its stones, a new stone
    entering with its id.  Blocks of ``stones`` that a region delete has cut count
    as one block while they share a label.  Both results read tables of ``scratch``.
    """
    scratch = scratch or Scratch(moves.sparkSession)
    moves = moves.select(*_MOVE, "x", "y", "uid")
    rule = moves.withColumn("outcome", constraint_reason())
    valid = F.col("outcome").isNull()
    on_board = F.col("x").isNotNull() & F.col("y").isNotNull()
    play = rule.filter(valid & on_board).drop("outcome").withColumn("pinned", F.lit(False))
    job = _Job(scratch, fold_limit, tile, stones is not None)
    if stones is None:
        stones = play.limit(0).withColumn("bid", F.col("id"))
    given = stones.select("board_id", "id", "x", "y", "uid", "bid").withColumn(
        "pinned", F.lit(False)
    )
    off_board = given.filter(~on_board)
    state, results = _advance(job, given.filter(on_board).select(*_STATE), play)
    loose = rule.filter(valid & ~on_board)
    entered = loose.select(
        "board_id", "id", "x", "y", "uid", F.col("id").alias("bid"), F.lit(False).alias("pinned")
    )
    everything = state.unionByName(entered).unionByName(off_board).drop("pinned")
    refused = rule.filter(~valid)
    extra = refused.unionByName(loose.withColumn("outcome", F.lit("placed"))).select(
        *_MOVE, "x", "y", "uid", "outcome",
        F.lit(0).cast("long").alias("captured"), F.lit(False).alias("merged"),
    )
    log = results.drop("pinned").unionByName(extra)
    return Replay(everything, log, job.labelling("bid"))


class _Job(NamedTuple):
    scratch: Scratch
    fold_limit: int
    tile: int
    may_be_cut: bool

    def labelling(self, tie: str) -> dict:
        """Arguments of ``label_blocks``.  Without given stones no block is cut, so
        connected cells alone tell the blocks and every stone entered with its id."""
        return {
            "tie": tie if self.may_be_cut else None,
            "tile": self.tile,
            "scratch": self.scratch,
        }


def _advance(job: _Job, stones: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Play ``moves`` on ``stones``; returns the new state and one result per move.

    A ``pinned`` stone has a liberty outside the part of the board at hand.
    """
    write = job.scratch.write
    # Attempts are combined before they meet the stones: a popular cell is one row there.
    first = (
        moves.groupBy(*CELL)
        .agg(
            F.min("id").alias("id"),
            F.min_by("uid", "id").alias("uid"),
            F.min_by("pinned", "id").alias("pinned"),
        )
        .join(stones.select(*CELL), CELL, "left_anti")
    )
    fill = label_blocks(
        stones.withColumn("arrived", F.lit(None).cast("long")).unionByName(
            first.withColumn("bid", F.col("id")).withColumn("arrived", F.col("id"))
        ),
        out="label", **job.labelling("bid"),
    )
    block = ["board_id", "label"]
    came = F.coalesce("arrived", F.lit(_LONG_AGO))
    fill = fill.withColumn("_came", came)
    sided = write(
        fill.withColumns(
            {
                "_open": F.col("pinned") | any_of(sides(fill, lambda near: near("uid").isNull())),
                "joined": any_of(
                    sides(
                        fill,
                        lambda near: (near("uid") == F.col("uid"))
                        & (near("_came") < F.col("_came")),
                    )
                ),
            }
        ).drop("_came"),
        "filled",
    )
    alive_labels = write(sided.filter("_open").select(*block).distinct(), "alive")
    sided = sided.drop("_open")
    dead = write(sided.join(alive_labels, block, "left_anti"), "dead")
    if dead.isEmpty():
        return sided.select(*_STATE), _settled_results(sided, moves)
    alive = sided.join(dead.select(*_MOVE), _MOVE, "left_anti")
    settled = alive.select(*_STATE)

    regions = label_blocks(
        dead.drop("joined"), owner=None, out="region", written=True,
        **job.labelling("label"),
    )
    cells = regions.select(*CELL, "region")
    events = write(_events(regions, alive, moves.join(cells, CELL)), "events")
    home = ["board_id", "region"]
    arrives = F.col("kind").isin(tasks.MOVE, tasks.WALL_MOVE)
    sizes = write(
        events.groupBy(*home).agg(
            F.count(F.lit(1)).alias("n"), F.sum(arrives.cast("long")).alias("n_moves")
        ),
        "region-sizes",
    )
    # Nothing happens in a region without a move: its stones stay, however many they are.
    quiet = sizes.filter("n_moves = 0").select(*home)
    # Moves can be halved; stones alone make a region too large only far beyond that.
    too_many = (F.col("n_moves") > job.fold_limit) | (F.col("n") > STONES_PER_MOVE * job.fold_limit)
    big = sizes.filter((F.col("n_moves") > 0) & too_many)
    has_big, has_quiet = not big.isEmpty(), not quiet.isEmpty()
    small = events
    if has_quiet:
        small = small.join(quiet, home, "left_anti")
    if has_big:
        small = small.join(big.select(*home), home, "left_anti")
    folded = write(
        small.repartition(*home)
        .sortWithinPartitions(*home, "step", "id")
        .select(*home, "kind", "id", "x", "y", "uid", "bid")
        .mapInArrow(tasks.fold_regions, _FOLD_SCHEMA),
        "folded",
    )
    survivors = folded.filter(F.col("kind") == tasks.PRESENT).select(
        "board_id", "id", "x", "y", "uid", "bid", F.lit(False).alias("pinned")
    )
    played = folded.filter(F.col("kind") != tasks.PRESENT).select(
        "board_id", "id", "x", "y", "uid",
        (F.col("kind") == tasks.WALL_MOVE).alias("pinned"),
        F.when(F.col("outcome") == tasks.PLACED, "placed")
        .when(F.col("outcome") == tasks.OCCUPIED, "occupied")
        .otherwise("suicide")
        .alias("outcome"),
        "captured",
        "merged",
    )
    if has_quiet:
        untouched = events.join(quiet, home, "left_semi").filter(F.col("kind") == tasks.PRESENT)
        survivors = survivors.unionByName(
            untouched.select("board_id", "id", "x", "y", "uid", "bid", F.lit(False).alias("pinned"))
        )
    if has_big:
        more_stones, more_results = _oversized(job, events.join(big.select(*home, "n_moves"), home))
        survivors = survivors.unionByName(more_stones)
        played = played.unionByName(more_results)

    # A settled move can capture in several regions; their shares are added up.
    share = (
        played.filter("pinned")
        .groupBy(*_MOVE)
        .agg(F.sum("captured").alias("_c"), F.max("merged").alias("_m"))
    )
    base = _settled_results(alive, moves.join(cells, CELL, "left_anti"))
    results = (
        base.join(share, _MOVE, "left")
        .withColumn("captured", F.col("captured") + F.coalesce("_c", F.lit(0)))
        .withColumn("merged", F.col("merged") | F.coalesce("_m", F.lit(False)))
        .select(*_RESULT)
        .unionByName(played.filter("not pinned").select(*_RESULT))
    )
    return settled.unionByName(survivors), results


def _settled_results(alive: DataFrame, moves: DataFrame) -> DataFrame:
    """Results of the moves on settled cells: the first mover is placed."""
    placed = alive.filter("arrived is not null")
    known = placed.select(*_MOVE, F.lit("placed").alias("outcome"), F.col("joined").alias("merged"))
    return moves.join(known, _MOVE, "left").select(
        "board_id", "id", "x", "y", "uid", "pinned",
        F.coalesce("outcome", F.lit("occupied")).alias("outcome"),
        F.lit(0).cast("long").alias("captured"),
        F.coalesce("merged", F.lit(False)).alias("merged"),
    )


def _events(regions: DataFrame, alive: DataFrame, moves: DataFrame) -> DataFrame:
    """All that happens in or next to each region: its present stones, the moves on
    its cells, and the settled cells around it."""
    columns = ["board_id", "region", "kind", "step", "id", "x", "y", "uid", "bid"]
    present = regions.filter("arrived is null").withColumns(
        {"kind": F.lit(tasks.PRESENT).cast("long"), "step": F.lit(0)}
    )
    tries = moves.withColumns(
        {"kind": F.lit(tasks.MOVE).cast("long"), "step": F.lit(1), "bid": F.col("id")}
    )
    came = F.col("arrived").isNotNull()
    walls = (
        neighbours(regions.select(*CELL, "region"), distinct=True)
        .join(alive.select(*CELL, "id", "uid", "bid", "arrived"), CELL)
        .withColumns(
            {
                "kind": F.when(came, tasks.WALL_MOVE).otherwise(tasks.WALL_PRESENT).cast("long"),
                "step": came.cast("int"),
            }
        )
    )
    return (
        present.select(*columns).union(tries.select(*columns)).union(walls.select(*columns))
    )


def _oversized(job: _Job, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Play the regions that are too large for one task."""
    wall = F.col("kind").isin(tasks.WALL_PRESENT, tasks.WALL_MOVE)
    arrives = F.col("kind").isin(tasks.MOVE, tasks.WALL_MOVE)
    tagged = events.withColumn("pinned", wall)
    lone = tagged.filter("n_moves = 1")
    stones, results = None, None
    if not lone.isEmpty():
        stones, results = _single_moves(job, lone)
    many = tagged.filter("n_moves > 1")
    if not many.isEmpty():
        state = many.filter(~arrives).select(*_STATE).dropDuplicates(_MOVE)
        moves = many.filter(arrives).select(
            "board_id", "id", "x", "y", "uid", "pinned"
        ).dropDuplicates(_MOVE)
        half = lookup_table(
            moves.groupBy("board_id").agg(F.percentile_approx("id", 0.5).alias("_cut")),
            "cuts", job.scratch,
        )
        timed = job.scratch.write(moves.join(half, "board_id"), "halves")
        early = timed.filter("id <= _cut").drop("_cut")
        late = timed.filter("id > _cut").drop("_cut")
        between, before = _advance(job, job.scratch.write(state, "state"), early)
        between = job.scratch.write(between, "state")
        before = job.scratch.write(before, "results")
        after, rest = _advance(job, between, late)
        after = job.scratch.write(after.filter("not pinned"), "state")
        rest = before.unionByName(job.scratch.write(rest, "results"))
        stones = after if stones is None else stones.unionByName(after)
        results = rest if results is None else results.unionByName(rest)
    return stones.select(*_STATE), results.select(*_RESULT)


def _single_moves(job: _Job, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One move against each of some large regions, by joins only."""
    write = job.scratch.write
    arrives = F.col("kind").isin(tasks.MOVE, tasks.WALL_MOVE)
    stones = label_blocks(
        events.filter(~arrives).select(*_STATE).dropDuplicates(_MOVE),
        out="_now", **job.labelling("bid"),
    )
    now = stones.withColumn("_entry", F.col("bid")).drop("bid").withColumnRenamed("_now", "bid")
    moves = events.filter(arrives).select(
        "board_id", "id", "x", "y", "uid", "pinned"
    ).dropDuplicates(_MOVE)
    judged = write(evaluate_moves(now, moves, job.scratch), "judged")
    taken = captured_blocks(
        now, judged.filter("accepted").withColumn("move_id", F.col("id"))
    ).select(*BLOCK)
    suicide = F.col("suicide") & ~F.col("pinned")
    own = (
        neighbours(judged.filter(suicide).select(*CELL, "uid"))
        .join(now.select(*CELL, "uid", "bid"), [*CELL, "uid"])
        .select(*BLOCK)
    )
    gone = taken.union(own).distinct()
    left = now.join(gone, BLOCK, "left_anti").withColumn("bid", F.col("_entry")).select(*_STATE)
    stayed = judged.filter(F.col("accepted") & ~suicide).select(
        "board_id", "id", "x", "y", "uid", F.col("id").alias("bid"), "pinned"
    )
    results = judged.select(
        "board_id", "id", "x", "y", "uid", "pinned",
        F.when(~F.col("accepted"), "occupied").when(suicide, "suicide").otherwise("placed").alias("outcome"),
        F.col("captured_stones").alias("captured"),
        F.col("merged_bid").isNotNull().alias("merged"),
    )
    return left.unionByName(stayed).filter("not pinned"), results
