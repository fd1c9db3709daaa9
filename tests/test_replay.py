import random
import time

import pytest
from plain_fold import play

from tessera.functions import tasks
from tessera.operators.blocks import dead_blocks, label_blocks
from tessera.plans.replay import replay

A = [
    (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0),
    (0, 2, 1), (0, -2, 1), (-2, 0, 1), (2, 0, 1),
    (-1, 1, 1), (-1, -1, 1), (1, 1, 1), (1, -1, 1), (0, 0, 2),
    (100, 2, 0), (100, 3, 0), (100, 4, 1),
    (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0),
]
B = [(9, 8, 1), (8, 9, 1), (9, 10, 1), (10, 8, 2), (11, 9, 2), (10, 10, 2), (9, 9, 2), (10, 9, 1)]
MOVES = "board_id long, id long, x long, y long, uid long"


def frame(spark, boards):
    rows = [(b, *m) for b, moves in boards.items() for m in moves]
    return spark.createDataFrame(rows, MOVES)


def numbered(cells):
    return [(i + 1, *c) for i, c in enumerate(cells)]


def check(spark, boards, start=None, **kw):
    stones = None
    if start:
        rows = [(b, i, x, y, l, u) for b, s in start.items() for (x, y), (i, u, l) in s.items()]
        stones = spark.createDataFrame(
            rows, "board_id long, id long, x long, y long, bid long, uid long"
        )
    out = replay(frame(spark, boards), stones, **kw)
    final = {(r.board_id, r.x, r.y): (r.id, r.uid, r.bid) for r in out.final.collect()}
    log = {(r.board_id, r.id): (r.outcome, r.captured, r.merged) for r in out.log.collect()}
    want_final, want_log = {}, {}
    for b, moves in boards.items():
        state, entries = play(moves, dict(start.get(b, {})) if start else None)
        want_final |= {(b, *c): s for c, s in state.items()}
        want_log |= {(b, i): e for i, e in entries.items()}
    assert log == want_log
    assert final == want_final
    return out, want_log


def test_scenarios(spark):
    out, log = check(spark, {1: numbered(A), 2: numbered(B)})
    assert log[1, 13] == ("placed", 4, False)
    assert [log[1, i][0] for i in (17, 18, 19, 20)] == ["suicide"] * 4
    assert log[2, 8] == ("placed", 1, False)
    rows = {(r.id, r.x, r.y, r.uid, r.bid) for r in out.final.filter("board_id = 1").collect()}
    stones = {
        (5, 0, 2, 1), (6, 0, -2, 1), (7, -2, 0, 1), (8, 2, 0, 1), (9, -1, 1, 1),
        (10, -1, -1, 1), (11, 1, 1, 1), (12, 1, -1, 1), (13, 0, 0, 2),
        (14, 100, 2, 0), (15, 100, 3, 0), (16, 100, 4, 1),
    }
    assert {r[:4] for r in rows} == stones
    assert {r[4] for r in rows if r[0] in (14, 15)} == {14}
    rows = {(r.id, r.x, r.y, r.uid, r.bid) for r in out.final.filter("board_id = 2").collect()}
    assert rows == {
        (1, 9, 8, 1, 1), (2, 8, 9, 1, 2), (3, 9, 10, 1, 3), (4, 10, 8, 2, 4),
        (5, 11, 9, 2, 5), (6, 10, 10, 2, 6), (8, 10, 9, 1, 8),
    }


def random_boards(seed, boards, size, n, owners):
    rng = random.Random(seed)
    return {
        b: [
            (i + 1, rng.randrange(size) - size // 2, rng.randrange(size) - size // 2, rng.randrange(owners))
            for i in range(n)
        ]
        for b in range(boards)
    }


@pytest.mark.parametrize(
    "seed,boards,size,n,owners,limit,tile",
    [
        (1, 60, 5, 120, 2, 20000, 64),
        (2, 20, 9, 400, 2, 20000, 4),
        (3, 3, 6, 150, 2, 25, 4),
        (4, 2, 8, 160, 3, 40, 64),
    ],
)
def test_random_boards(spark, seed, boards, size, n, owners, limit, tile):
    out, log = check(
        spark, random_boards(seed, boards, size, n, owners), fold_limit=limit, tile=tile
    )
    assert any(e[1] for e in log.values()) and any(e[0] == "suicide" for e in log.values())
    labels = label_blocks(out.final.drop("bid"), tile=3)
    assert labels.exceptAll(out.final.select(labels.columns)).isEmpty()
    assert dead_blocks(out.final).isEmpty()


def test_on_top_of_a_cut_state(spark):
    """Halves of a cut block share a label, and so their liberties."""
    rng = random.Random(7)
    boards, start = {}, {}
    for b in range(25):
        first = [(i + 1, rng.randrange(5), rng.randrange(5), rng.randrange(2)) for i in range(40)]
        state, _ = play(first)
        start[b] = {c: s for c, s in state.items() if c[0] != 2}
        boards[b] = [(i + 100, rng.randrange(5), rng.randrange(5), rng.randrange(2)) for i in range(60)]
    check(spark, boards, start)
    few = {b: boards[b] for b in (0, 1)}
    check(spark, few, {b: start[b] for b in few}, fold_limit=12, tile=3)


def test_small_rules(spark):
    edge = [(1, 10000, 0, 1), (2, 10001, 0, 1), (3, 10000, 0, 2), (4, 0, -10001, 1)]
    # The capturing stone has no liberty of its own until it captures.
    first = numbered([(0, 0, 1), (1, 0, 2), (0, 1, 2), (-1, -1, 2), (0, -1, 1), (1, -1, 2),
                      (0, -2, 2), (-2, 0, 1), (-1, 1, 1), (-1, 0, 2)])
    three = numbered([(0, 0, 1), (2, 0, 1), (1, 1, 1), (1, 0, 1)])
    out, log = check(spark, {1: edge, 2: first, 3: three})
    assert log[1, 2][0] == "out_of_range" and log[1, 3][0] == "occupied"
    assert {r.bid for r in out.final.filter("board_id = 3").collect()} == {1}


def test_missing_coordinates_are_placed_apart(spark):
    rows = [(1, 1, None, 0, 1), (1, 2, None, 0, 1), (1, 3, 0, 0, None), (1, 4, 0, 0, 1)]
    out = replay(spark.createDataFrame(rows, MOVES))
    log = {r.id: r.outcome for r in out.log.collect()}
    assert log == {1: "placed", 2: "placed", 3: "null_owner", 4: "placed"}
    assert {(r.id, r.bid) for r in out.final.collect()} == {(1, 1), (2, 2), (4, 4)}


def test_regions_without_a_move_stay_whatever_their_size(spark):
    """A liberty-less block that nothing touches, alone and beside a region that is divided."""
    ring = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    dead = {(0, 0): (1, 1, 1)} | {c: (k + 2, 2, k + 2) for k, c in enumerate(ring)}
    outer = [(0, 2), (0, -2), (2, 0), (-2, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)]
    closed = dead | {c: (k + 10, 1, k + 10) for k, c in enumerate(outer)}
    calm = {0: [(100, 50, 50, 1)]}
    for start in (dead, closed):
        check(spark, calm, {0: start}, fold_limit=3)
    busy = random_boards(3, 1, 6, 60, 2)[0]
    far = {(x + 40, y): s for (x, y), s in closed.items()}
    check(spark, {0: [(i + 100, x, y, u) for i, x, y, u in busy]}, {0: far}, fold_limit=3)
    check(spark, {0: [(i + 100, x, y, u) for i, x, y, u in busy], 1: []}, {0: far, 1: closed}, fold_limit=5)


def test_fold_takes_time_in_line_with_events():
    """A large block hemmed in, with moves beside it: its liberties are not counted anew."""

    def events(n):
        side = int(n**0.5)
        inner = [(0, k + 1, k % side, k // side, 1, 1) for k in range(side * side)]
        rim = [(x, y) for x in range(-1, side + 1) for y in (-1, side)]
        rim += [(x, y) for y in range(side) for x in (-1, side)]
        moves = [(1, 10**6 + k, x, y, 2, 0) for k, (x, y) in enumerate(rim)]
        again = [(1, 2 * 10**6 + k, *rim[k % len(rim)], 3, 0) for k in range(n)]
        return inner + moves + again

    def seconds(n):
        begin = time.process_time()
        results, _ = tasks.fold_region(events(n))
        assert max(r[6] for r in results) == int(n**0.5) ** 2
        return time.process_time() - begin

    seconds(1000)
    assert seconds(40_000) < 3.0
    lone = [(0, k + 1, k, 0, 1, 1) for k in range(6000)]
    beside = [(1, 10_000 + k, k, 1, 2, 0) for k in range(6000)]
    begin = time.process_time()
    tasks.fold_region(lone + beside)
    assert time.process_time() - begin < 1.0
