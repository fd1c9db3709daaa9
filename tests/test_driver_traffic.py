"""Joins of tables that grow with the input send nothing through the driver."""

import pytest
from test_maintained import STONES, batches, check

from tessera.operators.blocks import label_blocks
from tessera.operators.maintained import BlockView
from tessera.operators.rects import rects_join

LIMIT = "spark.sql.maxBroadcastTableSize"


@pytest.fixture
def no_broadcasts(spark):
    """Any table that is broadcast is an error."""
    spark.conf.set(LIMIT, "1b")
    yield
    spark.conf.unset(LIMIT)


def test_a_view_broadcasts_nothing(spark, tmp_path, no_broadcasts):
    view = BlockView(spark, str(tmp_path), buckets=3, tile=4)
    gone = STONES[: STONES.rindex(",")]
    for placed, removed, left in batches(5, 2, 7, 3):
        view.apply(spark.createDataFrame(placed, STONES), spark.createDataFrame(removed, gone))
    rows = [(r, b, -3, -3, 3, 3 + r) for r in range(4) for b in range(2)]
    boxes = spark.createDataFrame(rows, "request_id long, board_id long, x1 long, y1 long, x2 long, y2 long")
    before = {r.id: r for r in view.stones(1).collect()}
    hits = rects_join(boxes, view.changes(1, 3)).collect()
    spark.conf.unset(LIMIT)  # the plain block table that it is compared with may broadcast
    check(spark, view, left)
    now = {s[1]: s for s in left}
    want = {(s[0], i, 1) for i, s in now.items() if i not in before}
    want |= {(s.board_id, i, -1) for i, s in before.items() if i not in now}
    at = {i: (s.x, s.y) for i, s in before.items()} | {i: (s[2], s[3]) for i, s in now.items()}
    assert {(h.request_id, h.board_id, h.id, h.change) for h in hits} == {
        (r, b, i, c) for r, bb, x1, y1, x2, y2 in rows for b, i, c in want
        if b == bb and x1 <= at[i][0] <= x2 and y1 <= at[i][1] <= y2
    }
    assert {h.change for h in hits} == {1, -1}


def test_labels_broadcast_nothing(spark, no_broadcasts):
    rows = [(1, i, i, 0, 1) for i in range(20)] + [(1, 50, 0, 5, 2), (2, 60, 3, 3, 1)]
    got = label_blocks(spark.createDataFrame(rows, STONES), tile=4).collect()
    assert {r.id: r.bid for r in got} == {**{i: 0 for i in range(20)}, 50: 50, 60: 60}
