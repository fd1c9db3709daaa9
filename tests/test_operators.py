"""Each operator on small literal frames, and against brute force on random ones."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from plain_fold import around, step

from tessera.functions import geometry as geo
from tessera.functions.clock import minute_component, minutes_since
from tessera.operators import blocks, capture, ingest, last, rects, regions, report
from tessera.plans.replay import replay
from tessera.schema import STONES
from tessera.sources.snapshot import export_snapshot, load_stones
from tessera.sources.wire import parse_moves, parse_rect_requests

CELLS = "board_id long, id long, x long, y long, uid long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def board(spark, cells, board_id=1):
    """Stones with ids in order and bid = 0 unless given as a fifth value."""
    data = [(board_id, i + 1, c[0], c[1], c[3] if len(c) > 3 else 0, c[2]) for i, c in enumerate(cells)]
    return spark.createDataFrame(data, STONES)


def random_cells(seed, boards, size, n, owners):
    rng = random.Random(seed)
    out = {}
    for b in range(boards):
        cells = {}
        for i in range(n):
            c = (rng.randrange(size) - size // 2, rng.randrange(size) - size // 2)
            cells.setdefault(c, (i + 1, rng.randrange(owners)))
        out[b] = cells
    return out


def flood(cells):
    """Smallest id of each cell's component."""
    label = {}
    for c in sorted(cells, key=lambda c: cells[c][0]):
        if c in label:
            continue
        todo, label[c] = [c], cells[c][0]
        while todo:
            for n in around(todo.pop()):
                if n in cells and n not in label and cells[n][1] == cells[c][1]:
                    label[n] = cells[c][0]
                    todo.append(n)
    return label


@pytest.mark.parametrize("tile,size,n,owners", [(64, 12, 90, 2), (4, 30, 800, 2), (3, 24, 560, 1)])
def test_label_blocks_matches_flood_fill(spark, tile, size, n, owners):
    made = random_cells(tile, 4, size, n, owners)
    df = spark.createDataFrame(
        [(b, i, x, y, u) for b, cells in made.items() for (x, y), (i, u) in cells.items()], CELLS
    )
    got = rows(blocks.label_blocks(df, tile=tile), "board_id", "x", "y", "bid")
    want = sorted((b, x, y, l) for b, cells in made.items() for (x, y), l in flood(cells).items())
    assert got == want


def test_label_blocks_long_path_and_null_cells(spark):
    """A snake over many tiles, labelled from its far end; stones off the board."""
    path = []
    for row in range(0, 20, 2):
        xs = range(20) if row % 4 == 0 else range(19, -1, -1)
        path += [(x, row) for x in xs] + [(19 if row % 4 == 0 else 0, row + 1)]
    data = [(1, len(path) - i, x, y, 5) for i, (x, y) in enumerate(path)]
    data += [(1, 1000, None, 0, 5), (1, 1001, None, 0, 5)]
    got = blocks.label_blocks(spark.createDataFrame(data, CELLS), tile=4)
    assert rows(got.groupBy("bid").count(), "bid", "count") == [(1, len(path)), (1000, 1), (1001, 1)]


def test_tie_keeps_a_cut_block_together(spark):
    data = [(1, 1, 0, 0, 7, 1), (1, 2, 2, 0, 7, 1), (1, 3, 2, 1, 3, 1), (1, 4, 9, 9, 7, 1), (1, 5, 5, 5, 8, 1)]
    got = blocks.label_blocks(spark.createDataFrame(data, STONES), tie="bid")
    assert rows(got, "id", "bid") == [(1, 3), (2, 3), (3, 3), (4, 3), (5, 8)]


def test_liberties_of_an_l_shape(spark):
    df = blocks.label_blocks(board(spark, [(0, 0, 1), (0, 1, 1), (1, 0, 1)]))
    assert rows(blocks.liberty_counts(df), "bid", "uid", "liberties") == [(1, 1, 7)]
    assert rows(blocks.weighted_liberties(df), "weighted") == [(21,)]
    assert blocks.dead_blocks(df).isEmpty()
    assert rows(blocks.block_table(df), "bid", "uid", "qi") == [(1, 1, 7)]
    cells = df.select("board_id", "x", "y", "bid")
    assert blocks.stones_with_block(blocks.block_table(df), cells).count() == 3
    assert blocks.orphan_cells(blocks.block_table(df).filter("bid > 1"), cells).count() == 3


def test_random_boards_against_brute_force(spark):
    made = random_cells(11, 12, 9, 100, 3)
    df = blocks.label_blocks(
        spark.createDataFrame(
            [(b, i, x, y, u) for b, cells in made.items() for (x, y), (i, u) in cells.items()], CELLS
        )
    )
    free, dead, gone = {}, set(), []
    for b, cells in made.items():
        label = flood(cells)
        for c in cells:
            free.setdefault((b, label[c]), set()).update(n for n in around(c) if n not in cells)
        dead |= {(b, l) for l in label.values() if not free[b, l]}
        gone += [(b, cells[c][0]) for c in cells if (b, label[c]) in dead]
    assert dead
    got = rows(blocks.liberty_counts(df), "board_id", "bid", "liberties")
    assert got == sorted((*k, len(v)) for k, v in free.items())
    assert rows(blocks.liberties(df), "board_id", "bid", "x", "y") == sorted(
        (*k, *c) for k, v in free.items() for c in v
    )
    assert rows(blocks.dead_blocks(df), "board_id", "bid") == sorted(dead)
    split = blocks.sweep(df)
    assert rows(split.removed, "board_id", "id") == sorted(gone)
    assert split.kept.count() + len(gone) == df.count()


def states(seed, boards, size, n, owners):
    """Boards played by the plain rules, so no block is dead."""
    rng = random.Random(seed)
    out = {}
    for b in range(boards):
        out[b] = {}
        for i in range(n):
            step(out[b], (i + 1, rng.randrange(size), rng.randrange(size), rng.randrange(owners)))
    return out


def stones_of(spark, made):
    return spark.createDataFrame(
        [(b, i, x, y, l, u) for b, s in made.items() for (x, y), (i, u, l) in s.items()], STONES
    )


def test_evaluate_moves_equals_one_step(spark):
    made = states(5, 30, 5, 45, 2)
    moves, want = [], {}
    for b, state in made.items():
        for x in range(-1, 6):
            for y in range(-1, 6):
                for u in range(3):
                    after = dict(state)
                    outcome, captured, merged = step(after, (1000, x, y, u))
                    lost = len([c for c in state if state[c][1] == u and c not in after])
                    near = [state[n][2] for n in around((x, y)) if n in state and state[n][1] == u]
                    ok = outcome != "occupied"
                    want[b, x, y, u] = (
                        ok, captured, outcome == "suicide",
                        lost + 1 if outcome == "suicide" else 0,
                        min(near) if ok and near else None,
                    )
                    moves.append((b, len(moves), x, y, u))
    moves = spark.createDataFrame(moves, "board_id long, move_id long, x long, y long, uid long")
    got = {
        (r.board_id, r.x, r.y, r.uid): (r.accepted, r.captured_stones, r.suicide, r.lost_stones, r.merged_bid)
        for r in capture.evaluate_moves(stones_of(spark, made), moves).collect()
    }
    assert got == want
    assert any(w[1] for w in want.values()) and any(w[2] for w in want.values())


def test_settle_last_equals_the_rules(spark):
    rng = random.Random(3)
    made, before, after = states(8, 60, 5, 40, 2), {}, {}
    for b, state in made.items():
        free = [(x, y) for x in range(5) for y in range(5) if (x, y) not in state]
        if not free:
            continue
        c, u = rng.choice(free), rng.randrange(2)
        before[b] = {**state, c: (100, u, 100)}
        after[b] = dict(state)
        step(after[b], (100, *c, u))
    out = capture.settle_last(stones_of(spark, before))
    want = sorted((b, *c, i, l) for b, s in after.items() for c, (i, u, l) in s.items())
    assert rows(out.final, "board_id", "x", "y", "id", "bid") == want
    assert not out.captured.isEmpty() and not out.suicided.isEmpty()


def test_both_blocks_that_lose_their_last_liberty_go(spark):
    cells = [(0, 0, 1, 1), (2, 0, 2, 2), (-1, 0, 3, 3), (0, 1, 3, 4), (0, -1, 3, 5),
             (2, 1, 3, 6), (2, -1, 3, 7), (3, 0, 3, 8), (1, 0, 3, 9)]
    df = board(spark, cells)
    assert rows(blocks.need_clear(df), "need") == [(True,)]
    assert rows(capture.capture_last(df).removed, "id") == [(1,), (2,)]


def test_last_stone_operators(spark):
    df = board(spark, [(0, 0, 1, 1), (1, 0, 2, 2), (5, 5, 1, 3), (0, 1, 1, 4)])
    assert rows(last.last_stone(df), "id", "x", "y") == [(4, 0, 1)]
    assert rows(last.adjoining(df), "id") == [(1,), (4,)]
    assert rows(last.open_sides(df), "open_sides") == [(3,)]
    assert rows(last.related_blocks(df), "bid", "side") == [(1, "own"), (4, "own")]
    assert rows(blocks.merge_last(df), "id", "bid") == [(1, 1), (2, 2), (3, 3), (4, 1)]
    df = board(spark, [(0, 0, 1, 1), (1, 0, 2, 2)])
    assert rows(last.related_except_own(df), "bid") == [(1,)]


def test_check_stones(spark):
    data = [(1, 1, 0, 0, 1), (1, 2, 0, 0, 2), (1, 3, 10000, -10000, 1), (1, 4, 10001, 0, 1),
            (1, 5, 0, -10001, 1), (1, 6, 1, 1, None), (1, 7, 1, 1, 1), (1, 8, None, 3, 1),
            (1, 9, None, 3, 1), (2, 1, 0, 0, 1), (1, 10, 7, 7, 1)]
    df = spark.createDataFrame(data, CELLS)
    taken = board(spark, [(7, 7, 9)])
    got = rows(ingest.check_stones(df, taken), "board_id", "id", "reason")
    reasons = {(b, i): r for b, i, r in got}
    assert reasons == {
        (1, 1): None, (1, 2): "occupied", (1, 3): None, (1, 4): "out_of_range",
        (1, 5): "out_of_range", (1, 6): "null_owner", (1, 7): None, (1, 8): None,
        (1, 9): None, (2, 1): None, (1, 10): "occupied",
    }
    accepted = rows(ingest.check_stones(df).filter("reason is null"), "board_id", "id")
    assert rows(ingest.first_writers(df), "board_id", "id") == accepted
    assert (1, 8) in accepted and (1, 9) in accepted


def test_ids_and_labels(spark):
    data = [(b, o) for b in (1, 2) for o in (5, 900, 901, 7, 100000, 3000)]
    df = spark.createDataFrame(data, "board_id long, at long")
    got = rows(ingest.assign_ids(df, "at", fan=16), "board_id", "at", "id")
    want = [(b, o, sorted({5, 900, 901, 7, 100000, 3000}).index(o) + 1) for b, o in data]
    assert got == sorted(want)
    stones = board(spark, [(0, 0, 1, 4), (1, 1, 1, 9)])
    boards = spark.createDataFrame([(1,), (2,)], "board_id long")
    assert rows(ingest.next_bid(stones, boards), "board_id", "next_bid") == [(1, 10), (2, 1)]
    batch = df.withColumnRenamed("at", "id").filter("id < 901")
    got = rows(ingest.assign_labels(batch, stones), "board_id", "id", "bid")
    assert got == [(1, 5, 10), (1, 7, 11), (1, 900, 12), (2, 5, 1), (2, 7, 2), (2, 900, 3)]


def test_border_and_area(spark):
    boards = spark.createDataFrame([(1,)], "board_id long")
    border = regions.make_border(boards)
    assert border.count() == 80 and rows(border.select("uid").distinct(), "uid") == [(4294967040,)]
    labelled = blocks.label_blocks(border.withColumn("id", (F.col("x") + 1) * 100 + F.col("y") + 2))
    assert labelled.select("bid").distinct().count() == 1
    assert regions.std_area(boards).count() == 361
    taken = regions.border_block(board(spark, [(-1, 3, 1, 6), (0, 0, 1, 2)])).filter("taken")
    assert rows(taken, "x", "y", "bid") == [(-1, 3, 7)]


def test_coded_deletes(spark):
    block = board(spark, [(18, 0, 1, 1), (17, 2, 1, 2), (1, 2, 5, 3), (1, 3, 5, 3), (-4, 9, 5, 3)])
    assert rows(regions.decode_rows(block, {"a": 0, "b": 2}), "a", "b") == [(1, 2)]
    assert rows(regions.delete_block_at_code(block).removed, "id") == [(3,), (4,), (5,)]
    origin = board(spark, [(0, 0, 1, 1), (0, 1, 1, 1), (3, 3, 1, 2)])
    assert rows(regions.delete_block_at_code(origin).removed, "id") == [(1,), (2,)]
    assert rows(regions.delete_rect_by_code(origin).removed, "id") == [(1,)]
    assert rows(regions.delete_rect_by_code(origin).kept, "id") == [(2,), (3,)]
    assert regions.delete_block_at_code(board(spark, [(3, 3, 1, 1)])).removed.isEmpty()
    # x1=4 > x2=0: reversed bounds remove nothing.
    reversed_box = board(spark, [(16, 4, 1, 1), (0, 0, 1, 2), (3, 0, 1, 3)])
    assert regions.delete_rect_by_code(reversed_box).removed.isEmpty()
    # All fourteen bits: x = 8191 + 8192.
    far = [(x, 0, 1, 1) for x in range(5, 19)] + [(16383, 0, 1, 2)]
    assert rows(regions.decode_rows(board(spark, far), {"a": 0}), "a") == [(16383,)]


def test_region_reset_keeps_labels(spark):
    df = blocks.label_blocks(board(spark, [(-2, 4, 1), (-1, 4, 1), (0, 4, 1), (18, 18, 2), (19, 18, 2)]))
    area = regions.std_area(df.select("board_id").distinct())
    for split in (regions.reset_region(df, area), regions.reset_square(df)):
        assert rows(split.kept, "id", "bid") == [(1, 1), (2, 1), (5, 4)]
        assert rows(split.removed, "id") == [(3,), (4,)]
    cut = blocks.label_blocks(board(spark, [(0, 0, 1), (1, 0, 1), (2, 0, 1)]))
    hole = spark.createDataFrame([(1, 0)], "x long, y long")
    assert rows(regions.reset_region(cut, hole).kept, "id", "bid") == [(1, 1), (3, 1)]


def test_rectangles(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(1500)}
    cells |= {(10000, 10000), (-10000, -10000), (9000, -9000)}
    df = board(spark, [(x, y, 3, 1) for x, y in sorted(cells)])
    boxes = [(-5, -5, 5, 5), (-5, -5, 5, 5), (-100, -100, 100, 100), (0, 0, 1, 1), (-90, 3, 90, 4),
             (-10000, -10000, 10000, 10000), (-(10**15), -(10**15), 10**15, 10**15),
             (8999, -9000, 9000, 9000), (20000, 0, 20001, 1)]
    boxes += [(x, y, x + rng.randrange(1, 70), y + rng.randrange(1, 70)) for x, y in list(cells)[:40]]
    asked = spark.createDataFrame(
        [(i, 1, *b) for i, b in enumerate(boxes)] + [(99, 2, 0, 0, 5, 5)],
        "request_id long, board_id long, x1 long, y1 long, x2 long, y2 long",
    )
    want = {
        i: sorted((x, y) for x, y in cells if b[0] <= x <= b[2] and b[1] <= y <= b[3])
        for i, b in enumerate(boxes)
    } | {99: []}
    for tile in (4, 8, 64):
        got = rows(rects.rect_counts(asked, df, tile=tile), "request_id", "stones")
        assert got == sorted((i, len(c)) for i, c in want.items())
    got = rows(rects.rects_join(asked, df), "request_id", "x", "y")
    assert got == sorted((i, *c) for i, cs in want.items() for c in cs)
    for size in (100, 65536):
        parts, promised = {}, {}
        for r in rects.rect_result_json(asked, df, part_cells=size).collect():
            doc = [(s["x"], s["y"]) for s in json.loads(r.body)]
            assert doc == sorted(doc, key=lambda c: (c[1], c[0]))
            assert r.part not in parts.setdefault(r.request_id, {})
            parts[r.request_id][r.part] = doc
            promised[r.request_id] = r.parts
        # All bands are there, and in order they make the one array of the box.
        for i, p in parts.items():
            assert sorted(p) == list(range(promised[i]))
            whole = sum((p[k] for k in sorted(p)), [])
            assert whole == sorted(want[i], key=lambda c: (c[1], c[0]))
        assert set(parts) == set(want)
        assert parts[99] == {0: []} and promised[0] == (1 if size > 100 else 2)


def test_extreme_bounds_end_no_batch(spark):
    low, high = -(2**63), 2**63 - 1
    text = [f"x1={low}&x2={high}&y1={low}&y2={high}", f"x1={high - 1}&x2={high}&y1=0&y2=1", f"x1=0&x2=1&y1={low}&y2={low + 1}", "x1=0&x2=1&y1=0&y2=1"]
    asked = parse_rect_requests(
        spark.createDataFrame([(i, 1, q) for i, q in enumerate(text)], "request_id long, board_id long, qs string")
    ).filter("code = 0").drop("code", "msg")
    df = board(spark, [(0, 0, 1), (5, 5, 2)])
    want = {0: 2, 1: 0, 2: 0, 3: 1}
    assert dict(rows(rects.rect_counts(asked, df), "request_id", "stones")) == want
    assert sorted(r.request_id for r in rects.rects_join(asked, df).collect()) == [0, 0, 3]
    found = {}
    for r in rects.rect_result_json(asked, df, part_cells=10**9).collect():
        found[r.request_id] = found.get(r.request_id, 0) + len(json.loads(r.body))
    assert found == want
    bodies = [f'{{"x":{high},"y":{low},"uid":{high}}}', f'{{"x":{low},"y":0,"uid":1}}', '{"x":0,"y":1,"uid":2}']
    moves = parse_moves(
        spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "board_id long, id long, body string")
    )
    judged = {r.id: (r.accepted, r.suicide) for r in capture.evaluate_moves(df, moves.drop("code")).collect()}
    assert judged == {0: (False, False), 1: (False, False), 2: (True, False)}
    played = {r.id: r.outcome for r in replay(moves.drop("code").withColumn("id", F.col("id") + 100), df).log.collect()}
    assert played == {100: "out_of_range", 101: "out_of_range", 102: "placed"}


def test_a_thin_box_meets_few_stones(spark):
    """Tiles fit a box in width and height apart."""
    boxes = spark.createDataFrame([(1, 1, -500, 0, 500, 1)], "request_id long, board_id long, x1 long, y1 long, x2 long, y2 long")
    grid = spark.range(1000 * 40).selectExpr(
        "1L as board_id", "id", "id % 1000 - 500 as x", "id div 1000 - 20 as y", "1L as uid"
    )
    shaped = rects._boxes(boxes, 8)
    met = rects._box_tiles(shaped).join(rects._stone_tiles(grid, shaped, 8), rects._TILE_KEY).count()
    assert rects.rects_join(boxes, grid).count() == 2000 and met <= 10 * 2000


def test_rect_filter_is_pushed_down(spark, tmp_path):
    path = export_snapshot(board(spark, [(0, 0, 1), (3, 4, 1), (4, 5, 1)]), str(tmp_path), dt.datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("/20240506-070809")
    stones = load_stones(spark, path)
    hit = geo.rect_filter(stones, 0, 0, 3, 4).select("x", "y")
    assert rows(hit, "x", "y") == [(0, 0), (3, 4)]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0)" in plan and "ReadSchema: struct<x:bigint,y:bigint>" in plan
    with pytest.raises(ValueError):
        geo.rect_filter(stones, 1, 0, 1, 5)


def test_geometry(spark):
    one = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "board_id long, x long, y long")
    assert geo.neighbours(one).count() == 8
    assert geo.neighbours(one, n=5, distinct=True).count() == 8
    views = spark.createDataFrame(
        [(800, 600, 400.0, 300.0, 1.0), (800, 600, 0.0, 0.0, 2.0)],
        "width long, height long, begin_x double, begin_y double, scale double",
    )
    got = rows(geo.viewport_rect(views), "x1", "y1", "x2", "y2")
    assert got == [(-17, -13, 17, 13), (7, 5, 25, 19)]
    points = spark.createDataFrame(
        [(-37.5, 37.5), (-12.6, 12.4)], "px double, py double"
    ).selectExpr("*", "0 as begin_x", "0 as begin_y", "1.0D as scale")
    assert rows(geo.snap_to_grid(points), "x", "y") == [(-1, 0), (-1, 2)]


def test_clock(spark):
    one = spark.sql(
        "select timestamp_ntz'2024-01-01 00:00:00.9' t, timestamp_ntz'2024-01-01 02:05:59' u,"
        " cast(null as timestamp_ntz) n"
    )
    got = one.select(
        minutes_since(F.col("t"), F.col("u")).alias("a"),
        minute_component(F.col("t"), F.col("u")).alias("b"),
        minutes_since(F.col("n"), F.col("u")).alias("c"),
    ).first()
    assert tuple(got) == (125, 5, None)


def moves_at(spark, seconds):
    start = dt.datetime(2024, 3, 31, 0, 0, 0)
    data = [(k, i, 0, 0, 1, start + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(seconds)]
    return spark.createDataFrame(data, "board_id long, id long, x long, y long, uid long, ts timestamp_ntz")


def test_idle_gaps(spark):
    seconds = [(1, 0), (1, 1199), (1, 1199 + 1200), (1, 2399.9), (1, 3599.0), (2, 5), (1, 9000)]
    got = rows(report.idle_gaps(moves_at(spark, seconds)), "board_id", "id", "next_id", "gap")
    assert got == [(1, 1, 2, 1200), (1, 3, 4, 1200), (1, 4, 6, 5401)]
    rng = random.Random(1)
    many = sorted((k, rng.randrange(200000)) for k in range(3) for _ in range(300))
    got = rows(report.idle_gaps(moves_at(spark, many)), "board_id", "idle_from", "gap")
    want = [(a[0], a[1], b[1] - a[1]) for a, b in zip(many, many[1:]) if a[0] == b[0] and b[1] - a[1] >= 1200]
    base = int((dt.datetime(2024, 3, 31) - dt.datetime(1970, 1, 1)).total_seconds())
    assert got == sorted((k, base + s, g) for k, s, g in want)


def test_reports(spark):
    df = board(spark, [(0, 0, 7), (1, 0, 7), (2, 0, 5), (3, 0, 6)])
    got = [tuple(r) for r in report.top_owners(df, 2).collect()]
    assert got == [(7, 2), (5, 1)]
    env = last.last_move_env(moves_at(spark, [(1, 0), (1, 61)]))
    assert rows(env, "name", "value") == [
        ("last_go_time", "2024-03-31 00:01:01"), ("last_uid", "1"), ("last_x", "0"),
        ("last_y", "0"), ("system_start_time", "2024-03-31 00:00:00"),
    ]
    assert rows(last.env_long(env, "last_uid"), "board_id", "last_uid") == [(1, 1)]


def test_played_boards_have_no_dead_block(spark):
    made = states(21, 10, 6, 80, 2)
    assert blocks.dead_blocks(stones_of(spark, made)).isEmpty()
