import random

from tessera.operators.blocks import block_table, label_blocks
from tessera.operators.maintained import BlockView

STONES = "board_id long, id long, x long, y long, uid long"


def batches(seed, boards, size, rounds, owners=2):
    """Rounds of removals (single stones and whole 2 x 2 squares) and placements, cells reused."""
    rng = random.Random(seed)
    there, n = {}, 0
    for k in range(rounds):
        removed = [c for c in there if rng.random() < 0.15] if k else []
        removed = [(c[0], there[c][0], c[1], c[2]) for c in removed]
        for b, _, x, y in removed:
            del there[(b, x, y)]
        placed = []
        for b in range(boards):
            for _ in range(size * size // 3):
                c = (b, rng.randrange(-size, size), rng.randrange(-size, size))
                if c not in there:
                    n += 1
                    there[c] = (n, rng.randrange(owners))
                    placed.append((b, n, c[1], c[2], there[c][1]))
        yield placed, removed, [(c[0], s[0], c[1], c[2], s[1]) for c, s in there.items()]


def check(spark, view, left):
    want = label_blocks(spark.createDataFrame(left, STONES))
    got = {(r.board_id, r.id): (r.x, r.y, r.uid, r.bid) for r in view.stones().collect()}
    assert got == {(r.board_id, r.id): (r.x, r.y, r.uid, r.bid) for r in want.collect()}
    assert sorted(map(tuple, view.blocks().collect())) == sorted(map(tuple, block_table(want).collect()))


def test_equals_fresh_labels_after_each_batch(spark, tmp_path):
    view = BlockView(spark, str(tmp_path), buckets=6, tile=4)
    seen = []
    for placed, removed, left in batches(12, 2, 7, 4):
        view.apply(spark.createDataFrame(placed, STONES), spark.createDataFrame(removed, STONES[: STONES.rindex(",")]))
        check(spark, view, left)
        seen.append(left)
    assert any(r.stones > 4 for r in view.table("blocks").collect())
    # Every earlier version can still be read, and two of them compared.
    for k, left in enumerate(seen):
        assert {r.id for r in view.stones(k + 1).collect()} == {s[1] for s in left}
    ids = [{s[1] for s in left} for left in seen]
    got = {(r.id, r.change) for r in view.changes(2, 4).collect()}
    assert got == {(i, 1) for i in ids[3] - ids[1]} | {(i, -1) for i in ids[1] - ids[3]}


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    view = BlockView(spark, str(tmp_path), buckets=64, tile=8)
    rows = [(b, b * 1000 + i, i, 0, 1) for b in range(40) for i in range(6)]
    view.apply(spark.createDataFrame(rows, STONES))
    before = view._manifest(1)
    view.read_buckets = {}
    more = [(7, 10**6, 6, 0, 1)]
    gone = [(7, 7002, 2, 0)]
    view.apply(spark.createDataFrame(more, STONES), spark.createDataFrame(gone, STONES[: STONES.rindex(",")]))
    assert all(len(b) <= 8 for b in view.read_buckets.values()), view.read_buckets
    changed = {n: {b for b, v in view._manifest(2)[n].items() if before[n].get(b) != v} for n in before}
    assert all(len(b) <= 6 for b in changed.values()), changed
    left = [r for r in rows if r[1] != 7002] + more
    check(spark, view, left)


def test_empty_batches_and_a_cell_taken_again(spark, tmp_path):
    view = BlockView(spark, str(tmp_path), buckets=3, tile=4)
    none = spark.createDataFrame([], STONES)
    view.apply(none)
    assert view.stones().count() == 0 and view.blocks().count() == 0
    view.apply(spark.createDataFrame([(1, 1, 0, 0, 5), (1, 2, 1, 0, 5), (1, 3, 2, 0, 5)], STONES))
    view.apply(
        spark.createDataFrame([(1, 4, 1, 0, 6)], STONES), spark.createDataFrame([(1, 2, 1, 0)], STONES[: STONES.rindex(",")])
    )
    check(spark, view, [(1, 1, 0, 0, 5), (1, 4, 1, 0, 6), (1, 3, 2, 0, 5)])
    view.apply(none, view.stones())
    assert view.stones().count() == 0 and view.blocks().count() == 0 and view.table("free").count() == 0
