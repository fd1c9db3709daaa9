import random

from plain_fold import play
from test_streams import MOVES, random_log, write_files

from tessera.plans.replay import replay
from tessera.schema import BORDER_OWNER
from tessera.streaming import keyed


def stream(spark, path):
    frame = spark.createDataFrame([], MOVES)
    return spark.readStream.schema(frame.schema).parquet(f"{path}/*")


def run(spark, at, batches, walls=None):
    """A run of the query for each batch: every one but the first restarts from the checkpoint."""
    for i in range(len(batches)):
        write_files(spark, at / f"in{i}", batches[i : i + 1], MOVES)
        moves = stream(spark, at / "in*")
        keyed.start_play(moves, str(at / "out"), str(at / "checkpoint"), walls).awaitTermination()
    return keyed.play_events(spark, str(at / "out")), keyed.play_stones(spark, str(at / "checkpoint"))


def test_equals_the_rules_over_restarts(spark, tmp_path):
    logs = random_log(9, 5, 120)
    batches = [[(b, *m) for b, ms in logs.items() for m in ms[k : k + 40]] for k in (0, 40, 80)]
    batches[2] += [(0, 5, 99, 99, 1), (7, 1, None, 3, 1), (7, 2, 0, 20000, 1), (7, 3, 1, 1, None)]
    for rows in batches:
        random.Random(1).shuffle(rows)
    events, stones = run(spark, tmp_path, batches)
    want_state, want_log = {}, {}
    for b, moves in logs.items():
        state, entries = play(moves)
        want_state |= {(b, *c): s for c, s in state.items()}
        want_log |= {(b, i): e for i, e in entries.items()}
    assert {(r.board_id, r.x, r.y): (r.id, r.uid, r.bid) for r in stones.collect()} == want_state
    rows = keyed.play_log(events.filter("not (board_id = 0 and id = 5)")).collect()
    got = {(r.board_id, r.id): (r.outcome, r.captured, r.merged) for r in rows}
    assert [got.pop((7, i))[0] for i in (1, 2, 3)] == ["placed", "out_of_range", "null_owner"]
    want_log.pop((0, 5))
    assert got == want_log
    again = events.filter("board_id = 0 and id = 5").collect()
    assert [r.reason for r in again if r.x == 99] == ["late"]
    assert any(e[1] for e in want_log.values()) and any(e[0] == "suicide" for e in want_log.values())
    # Placed stones that no later event took away are the ones in the state.
    gone = {r.stone for r in events.filter("kind in ('captured', 'suicide') and board_id = 1").collect()}
    put = {r.stone for r in events.filter("kind = 'placed' and board_id = 1").collect()}
    assert put - gone == {s[0] for c, s in want_state.items() if c[0] == 1}


def test_blocks_that_lose_their_last_liberty_together(spark, tmp_path):
    """Two enemy blocks of different owners, each without liberties only because of the other."""
    cells = [(0, 1, 2), (1, 1, 2), (1, 0, 3), (-1, 1, 9), (0, 2, 9), (1, 2, 9), (2, 1, 9), (1, -1, 9), (2, 0, 9), (0, 0, 1)]
    moves = [(1, i + 1, *c) for i, c in enumerate(cells)]
    events, stones = run(spark, tmp_path, [moves[:6], moves[6:]])
    state, log = play([m[1:] for m in moves])
    assert {(r.x, r.y): (r.id, r.uid, r.bid) for r in stones.collect()} == state
    assert {r.id: (r.outcome, r.captured, r.merged) for r in keyed.play_log(events).collect()} == log
    assert log[10] == ("placed", 3, False)


def test_walled_zones_of_one_hot_board(spark, tmp_path):
    """All moves on one board of small walled squares: keys by zone, equal to a replay with walls."""
    rng = random.Random(4)
    moves = [(3, i + 1, rng.randrange(-5, 15), rng.randrange(-5, 10), rng.randrange(2)) for i in range(900)]
    events, stones = run(spark, tmp_path, [moves[:400], moves[400:]], walls=(-1, 4))
    frame = spark.createDataFrame(moves, MOVES)
    zones = frame.select("board_id", keyed.walled_zone(frame.x, frame.y, -1, 4).alias("zone")).distinct()
    assert zones.count() == events.select("zone").distinct().count() > 10
    walls = keyed.walls_of(zones, -1, 4)
    assert walls.count() > 100
    want = replay(frame, walls)
    got = {r.id: (r.outcome, r.captured, r.merged) for r in keyed.play_log(events).collect()}
    assert got == {r.id: (r.outcome, r.captured, r.merged) for r in want.log.collect()}
    left = [r for r in want.final.collect() if r.uid != BORDER_OWNER]
    assert {(r.x, r.y, r.id, r.bid) for r in stones.collect()} == {(r.x, r.y, r.id, r.bid) for r in left}
    assert any(c[1] for c in got.values())
