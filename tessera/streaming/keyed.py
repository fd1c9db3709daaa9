"""Ordered replay as keyed state: every board, or walled zone of one, plays in the stream.

The state of a key is a map of square pages in the state store, each with the stones on its
cells and the blocks numbered after a stone placed there, so a move reads the pages of the cells
beside it and of the blocks they belong to, however large the board is.  A look into the store
costs about as much as playing a move; what a micro-batch touches is read page by page, once,
and written once.  A block knows its label, its size, how many open sides its stones have and
one stone of each connected part (it has several after a reset cut it: they keep one label and
live or die together); its stones are found along neighbours, and of merging blocks the smaller
one is rewritten.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.functions.clock import whole_seconds
from tessera.operators.ingest import constraint_reason
from tessera.schema import BORDER_OWNER, IDLE_SECONDS
from tessera.scratch import Scratch, joined

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = (
    "board_id long, zone long, id long, seq int, kind string, x long, y long, uid long, "
    "stone long, reason string"
)
_EVENT = Row(*[c.split()[0] for c in EVENTS.split(", ")])
PLACED, MERGED, CAPTURED, SUICIDE, REJECTED = "placed", "merged", "captured", "suicide", "rejected"
RESET = "reset"


class IdleReset(NamedTuple):
    """Clear the square from ``lo`` to ``hi`` before a move that comes ``seconds`` or more after
    the one before it."""

    lo: int = 0
    hi: int = 18
    seconds: int = IDLE_SECONDS


PAGE = 8
"""Edge length of a page in cells."""


def _page_of(c: tuple) -> tuple:
    return (c[0] // PAGE, c[1] // PAGE)


class _Pages:
    """The pages of a key: read from the store once and written back once for a micro-batch.

    In the store a page is two JSON lists of whole numbers, as one string costs less there than
    many numbers: ``[x, y, id, uid]`` and the number and page of the block for each stone, and
    number, label, size, open sides and the stones of its parts for each block.
    """

    def __init__(self, state):
        self.state, self.held, self.stored, self.changed = state, {}, set(), set()

    def page(self, at: tuple) -> tuple[dict, dict]:
        if at not in self.held:
            stones, blocks = {}, {}
            if (kept := self.state.getValue(at)) is not None:
                self.stored.add(at)
                stones = {(x, y): (i, u, (n, a, b)) for x, y, i, u, n, a, b in json.loads(kept[0])}
                blocks = {
                    (n, *at): (label, size, free, ends[::2], ends[1::2])
                    for n, label, size, free, *ends in json.loads(kept[1])
                }
            self.held[at] = stones, blocks
        return self.held[at]

    def flush(self) -> None:
        for at in self.changed:
            stones, blocks = self.held[at]
            if stones or blocks:
                kept = [(*c, i, u, *block) for c, (i, u, block) in stones.items()]
                numbered = [
                    (block[0], label, size, free, *(v for end in zip(xs, ys) for v in end))
                    for block, (label, size, free, xs, ys) in blocks.items()
                ]
                self.state.updateValue(at, (json.dumps(kept), json.dumps(numbered)))
            elif at in self.stored:
                self.state.removeKey(at)


class _Cache:
    """The stones (part 0) or the blocks (part 1) of the pages, by cell or by number and page."""

    def __init__(self, pages: _Pages, part: int, page_of: Callable[[tuple], tuple]):
        self.pages, self.part, self.page_of = pages, part, page_of

    def get(self, key: tuple):
        return self.pages.page(self.page_of(key))[self.part].get(key)

    def put(self, key: tuple, value: tuple | None) -> None:
        at = self.page_of(key)
        held = self.pages.page(at)[self.part]
        self.pages.changed.add(at)
        if value is None:
            held.pop(key, None)
        else:
            held[key] = value


def _around(c: tuple) -> tuple:
    x, y = c
    return ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))


class BoardPlayer(StatefulProcessor):
    """Plays the moves of one key in order of their id.

    ``walls`` is (lo, period): cells whose distance from ``lo`` in either direction is a
    multiple of the period belong to nobody and are never free.
    """

    def __init__(self, walls: tuple[int, int] | None = None, reset: IdleReset | None = None):
        self.walls, self.reset = walls, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "x long, y long", "stones string, blocks string")
        self.last = handle.getValueState("last", "id long, at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        board, zone = key
        last = self.last.get()
        pages = _Pages(self.pages)
        cells, blocks = _Cache(pages, 0, _page_of), _Cache(pages, 1, lambda block: block[1:])
        before = None if last is None else last[0]
        for move in sorted(rows, key=lambda r: r.id):
            if before is not None and move.id <= before:
                events = [(REJECTED, move.x, move.y, move.uid, None, "late")]
            else:
                if self.reset and last is not None and None not in (move.at, last[1]):
                    if move.at - last[1] >= self.reset.seconds:
                        for seq, event in enumerate(self._clear(cells, blocks)):
                            yield _EVENT(board, zone, move.id, -1 - seq, *event)
                if move.reason is not None:
                    events = [(REJECTED, move.x, move.y, move.uid, None, move.reason)]
                else:
                    events = self._play(cells, blocks, move.id, move.x, move.y, move.uid)
                last = (move.id, move.at)
            for seq, event in enumerate(events):
                yield _EVENT(board, zone, move.id, seq, *event)
        pages.flush()
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass

    def _wall(self, x: int, y: int) -> bool:
        if self.walls is None:
            return False
        lo, period = self.walls
        return (x - lo) % period == 0 or (y - lo) % period == 0

    @staticmethod
    def _grown(blocks: _Cache, block: tuple, by: int) -> None:
        label, size, free, xs, ys = blocks.get(block)
        blocks.put(block, (label, size, free + by, xs, ys))

    @staticmethod
    def _stones_of(cells: _Cache, blocks: _Cache, block: tuple) -> list[tuple]:
        """The cells of a block, along neighbours from a stone of each part."""
        _, _, _, xs, ys = blocks.get(block)
        ahead = list(zip(xs, ys))
        found = set(ahead)
        while ahead:
            for n in _around(ahead.pop()):
                if n not in found:
                    stone = cells.get(n)
                    if stone is not None and stone[2] == block:
                        found.add(n)
                        ahead.append(n)
        return list(found)

    def _remove(self, cells: _Cache, blocks: _Cache, block: tuple) -> list[tuple]:
        """Take a block off the board; its stones."""
        gone = self._stones_of(cells, blocks, block)
        stones = [(*c, *cells.get(c)[:2]) for c in gone]
        for c in gone:
            cells.put(c, None)
        blocks.put(block, None)
        for c in gone:
            for n in _around(c):
                beside = cells.get(n)
                if beside is not None:
                    self._grown(blocks, beside[2], 1)
        return sorted(stones, key=lambda s: s[2])

    def _clear(self, cells: _Cache, blocks: _Cache) -> list[tuple]:
        """Take all stones of the reset square away; what is left of a block keeps its label."""
        side = range(self.reset.lo, self.reset.hi + 1)
        gone = {c: s for c in ((x, y) for x in side for y in side) if (s := cells.get(c)) is not None}
        cut = {s[2] for s in gone.values()}
        left = {b: [c for c in self._stones_of(cells, blocks, b) if c not in gone] for b in cut}
        for c in gone:
            cells.put(c, None)
        for c in gone:
            for n in _around(c):
                beside = cells.get(n)
                if beside is not None and beside[2] not in cut:
                    self._grown(blocks, beside[2], 1)
        for block, stones in left.items():
            label = blocks.get(block)[0]
            free = sum(cells.get(n) is None and not self._wall(*n) for c in stones for n in _around(c))
            rest, ends = set(stones), []
            while rest:
                ends.append(rest.pop())
                ahead = [ends[-1]]
                while ahead:
                    for n in _around(ahead.pop()):
                        if n in rest:
                            rest.remove(n)
                            ahead.append(n)
            made = (label, len(stones), free, [x for x, _ in ends], [y for _, y in ends])
            blocks.put(block, made if stones else None)
        return [(RESET, *c, s[1], s[0], None) for c, s in gone.items()]

    def _play(self, cells: _Cache, blocks: _Cache, mid: int, x, y, uid: int) -> list[tuple]:
        placed = (PLACED, x, y, uid, mid, None)
        if x is None or y is None:
            return [placed]
        if self._wall(x, y) or cells.get((x, y)) is not None:
            return [(REJECTED, x, y, uid, None, "occupied")]
        events = [placed]
        beside = [s for s in map(cells.get, _around((x, y))) if s is not None]
        for stone in beside:
            self._grown(blocks, stone[2], -1)
        free = 4 - len(beside) - sum(self._wall(*n) for n in _around((x, y)))
        home = (mid, *_page_of((x, y)))
        cells.put((x, y), (mid, uid, home))
        blocks.put(home, (mid, 1, free, [x], [y]))
        own = {s[2] for s in beside if s[1] == uid}
        if own:
            home = self._merge(cells, blocks, own | {home})
            events.append((MERGED, x, y, uid, blocks.get(home)[0], None))
        # All are judged before one is taken away.
        enemy = {s[2] for s in beside if s[1] != uid}
        for block in sorted(b for b in enemy if blocks.get(b)[2] == 0):
            events += [(CAPTURED, a, b, u, i, None) for a, b, i, u in self._remove(cells, blocks, block)]
        if blocks.get(home)[2] == 0:
            events += [(SUICIDE, a, b, u, i, None) for a, b, i, u in self._remove(cells, blocks, home)]
        return events

    def _merge(self, cells: _Cache, blocks: _Cache, parts: set[tuple]) -> tuple:
        """Make one block of several beside a new stone; the largest keeps its number."""
        of = {b: blocks.get(b) for b in parts}
        home = max(of, key=lambda b: (of[b][1], -b[0]))
        for b in parts - {home}:
            for c in self._stones_of(cells, blocks, b):
                stone = cells.get(c)
                cells.put(c, (stone[0], stone[1], home))
            blocks.put(b, None)
        whole = all(len(v[3]) == 1 for v in of.values())
        ends = [of[home]] if whole else list(of.values())
        blocks.put(home, (
            min(v[0] for v in of.values()), sum(v[1] for v in of.values()), sum(v[2] for v in of.values()),
            [x for v in ends for x in v[3]], [y for v in ends for y in v[4]],
        ))
        return home


def walled_zone(x: Column, y: Column, lo: int = -1, hi: int = 19) -> Column:
    """The zone of a cell on a board that walls divide into equal squares.

    The squares are like the one that ``make_border(lo, hi)`` walls in, side by side, with one
    wall between two.  Stones of different zones are never adjacent, so each zone is a key.
    A cell of a wall counts to the zone above and to the right of it.
    """
    period = hi - lo
    column, row = (F.floor((v - lo) / F.lit(period)).cast("long") for v in (x, y))
    return F.coalesce((column + 32768) * 65536 + row + 32768, F.lit(0).cast("long"))


def stream_play(
    moves: DataFrame, walls: tuple[int, int] | None = None, reset: IdleReset | None = None
) -> DataFrame:
    """The events of a stream of moves (``board_id, id, x, y, uid``), in append mode.

    A row for each thing that happens, numbered by ``seq`` within its move: the stone is
    ``placed``, it ``merged`` (``stone`` is the label of the block), stones are ``captured``, or
    its own block, stone by stone (``suicide``); or the move is ``rejected`` (``reason``: a
    broken constraint, ``occupied``, or ``late``).  Rows of a micro-batch need no order; a move
    not above the last id its key has applied is late.

    A key is a board.  With ``walls`` (lo, hi), the bounds of ``make_border``, walls divide every
    board as ``walled_zone`` says and each zone is a key, so a hot board is played by many
    tasks.  Walls are never captured; a move on one is ``occupied``.

    With ``reset`` moves have a time ``ts``, and a square is cleared before the first move after
    an idle time of its key (``reset`` events, with negative ``seq`` of that move).
    """
    zone = F.lit(0).cast("long") if walls is None else walled_zone(F.col("x"), F.col("y"), *walls)
    spark = moves.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    Scratch(spark)  # gives the executors this package
    at = whole_seconds(F.col("ts")) if reset else F.lit(None)
    keyed = moves.select(
        "board_id", zone.alias("zone"), "id", "x", "y", "uid", constraint_reason().alias("reason"),
        at.cast("long").alias("at"),
    )
    player = BoardPlayer(None if walls is None else (walls[0], walls[1] - walls[0]), reset)
    return keyed.groupBy("board_id", "zone").transformWithState(
        statefulProcessor=player, outputStructType=EVENTS, outputMode="append", timeMode="none"
    )


def start_play(
    moves: DataFrame,
    out: str,
    checkpoint: str,
    walls: tuple[int, int] | None = None,
    reset: IdleReset | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the events of ``stream_play`` as Parquet; state and progress in ``checkpoint``."""
    writer = (
        stream_play(moves, walls, reset).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint).format("parquet")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)


def play_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(out)


def play_log(events: DataFrame) -> DataFrame:
    """One row per move, as ``replay`` gives: ``outcome``, ``captured``, ``merged``."""
    def has(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1))

    made = events.groupBy("board_id", "zone", "id").agg(
        F.max(F.when(F.col("seq") == 0, F.struct("x", "y", "uid", "reason"))).alias("m"),
        has(CAPTURED).alias("captured"), has(SUICIDE).alias("lost"), has(MERGED).alias("joined"),
    )
    outcome = F.when(F.col("m.reason").isNotNull(), F.col("m.reason")).when(F.col("lost") > 0, "suicide")
    return made.select(
        "board_id", "id", "m.x", "m.y", "m.uid", outcome.otherwise("placed").alias("outcome"),
        "captured", (F.col("joined") > 0).alias("merged"),
    )


def play_stones(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The labelled stones that the state store holds, as of the last committed micro-batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pages").load()

    def listed(name: str) -> Column:
        return F.from_json(f"user_map_value.{name}", "array<array<bigint>>").alias(name)

    # Written, as both sides of the join would read the whole store.
    pages = state.select("key.board_id", "key.zone", listed("stones"), listed("blocks"))
    pages = Scratch(spark).write(pages, "pages")
    stone, block = F.col("stone"), F.col("block")
    cells = pages.select("board_id", "zone", F.explode("stones").alias("stone")).select(
        "board_id", "zone", stone[4].alias("block"), stone[2].alias("id"),
        stone[0].alias("x"), stone[1].alias("y"), stone[3].alias("uid"),
    )
    blocks = pages.select("board_id", "zone", F.explode("blocks").alias("block")).select(
        "board_id", "zone", block[0].alias("block"), block[1].alias("bid")
    )
    labelled = joined(cells, blocks, ["board_id", "zone", "block"])
    return labelled.select("board_id", "id", "x", "y", "bid", "uid")


def walls_of(zones: DataFrame, lo: int = -1, hi: int = 19) -> DataFrame:
    """The wall stones around zones (``board_id``, ``zone``), as ``replay`` wants them: ids from
    -1 downwards, one label per board."""
    period = hi - lo
    column = (F.shiftright("zone", 16) - 32768) * period + lo
    row = (F.col("zone").bitwiseAND(F.lit(65535)) - 32768) * period + lo
    step = F.explode(F.sequence(F.lit(0), F.lit(period)))
    rim = zones.select("board_id", column.alias("cx"), row.alias("cy"), step.alias("k"))
    cells = F.array(*[
        F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
        for x, y in (
            (F.col("cx") + F.col("k"), F.col("cy")), (F.col("cx") + F.col("k"), F.col("cy") + period),
            (F.col("cx"), F.col("cy") + F.col("k")), (F.col("cx") + period, F.col("cy") + F.col("k")),
        )
    ])
    rim = rim.select("board_id", F.explode(cells).alias("c")).select("board_id", "c.x", "c.y").distinct()
    number = (F.col("x") + 40000) * 100000 + F.col("y") + 40000
    return rim.select(
        "board_id", (-number).alias("id"), "x", "y", F.lit(-1).cast("long").alias("bid"),
        F.lit(BORDER_OWNER).cast("long").alias("uid"),
    )
