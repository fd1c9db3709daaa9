"""Plans and hot keys: nothing may gather a hot board, block or cell in one task."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F
from plain_fold import play

from tessera.functions import tasks
from tessera.operators import blocks, ingest, rects, report
from tessera.plans.replay import replay
from tessera.scratch import Scratch, shared_dir


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {f"spark.sql.{k.replace('__', '.')}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def square(spark, n, board=1, uid=1):
    """A full ``n`` x ``n`` block of one owner."""
    return spark.range(n * n).select(
        F.lit(board).cast("long").alias("board_id"),
        F.col("id"),
        (F.col("id") % n - n // 2).alias("x"),
        (F.floor(F.col("id") / n) - n // 2).cast("long").alias("y"),
        F.lit(uid).cast("long").alias("uid"),
    )


def test_one_huge_block_is_labelled_across_tiles(spark):
    got = blocks.label_blocks(square(spark, 150), tile=16)
    assert [tuple(r) for r in got.groupBy("bid").count().collect()] == [(0, 22500)]


def test_hot_block_is_split_by_the_join(spark):
    """Half of all stones carry one dead label; the join splits that partition."""
    hot = square(spark, 200).withColumn("bid", F.lit(0).cast("long"))
    edge = square(spark, 202).withColumn("bid", F.lit(0).cast("long"))
    ring = edge.filter("x in (-101, 100) or y in (-101, 100)").withColumns(
        {"id": F.col("id") + 100000, "uid": F.lit(2).cast("long"), "bid": F.lit(100000).cast("long")}
    )
    cold = square(spark, 200, board=2).withColumn("bid", F.col("id"))
    stones = Scratch(spark).write(hot.union(ring).union(cold).repartition(16), "skewed")
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20k",
    ):
        removed = blocks.sweep(stones).removed
        rows = removed.collect()
        assert "skew=true" in plan_of(removed)
    assert len([r for r in rows if r.board_id == 1]) == 40000


def test_hot_cell_is_combined_before_the_shuffle(spark):
    tries = spark.range(50000).select(
        F.lit(1).cast("long").alias("board_id"), "id",
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 97).cast("long").alias("x"),
        F.lit(2).cast("long").alias("y"), (F.col("id") % 5).alias("uid"),
    )
    best = ingest.first_writers(tries)
    plan = plan_of(best)
    assert "SortAggregate" not in plan
    assert plan.index("Exchange") < plan.rindex("partial_min")
    assert best.count() == 97
    reasons = ingest.check_stones(tries).groupBy("reason").count()
    assert {tuple(r) for r in reasons.collect()} == {(None, 97), ("occupied", 50000 - 97)}


def test_idle_gaps_window_over_slots_only(spark):
    moves = spark.range(20000).select(
        F.lit(1).cast("long").alias("board_id"), "id",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
    )
    out = report.idle_gaps(moves)
    plan = plan_of(out)
    assert "SortAggregate" not in plan and "partial_max_by" in plan
    assert plan.index("Window") < plan.index("HashAggregate")
    assert out.isEmpty()


def test_liberties_shuffle_once_by_cell(spark):
    df = Scratch(spark).write(blocks.label_blocks(square(spark, 20)), "block")
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false"):
        plan = plan_of(blocks.liberties(df))
        # Two sides of the join by cell; the duplicates fall out in place.
        assert plan.count("Exchange hashpartitioning") == 2
        plan = plan_of(rects.rects_join(boxes(spark), df))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def boxes(spark):
    return spark.createDataFrame(
        [(1, 1, 0, 0, 5, 5)],
        "request_id long, board_id long, x1 long, y1 long, x2 long, y2 long",
    )


def test_replay_folds_only_what_can_be_captured(spark, monkeypatch):
    """One board with all moves: cells of blocks that keep a liberty never reach the
    ordered fold, and regions above the limit are divided."""
    rng = random.Random(6)
    rows = [(1, i, rng.randrange(55), rng.randrange(55), rng.randrange(2)) for i in range(1, 2500)]
    moves = spark.createDataFrame(rows, "board_id long, id long, x long, y long, uid long")
    seen = []
    write = Scratch.write

    def spy(self, df, name):
        out = write(self, df, name)
        if name == "folded":
            seen.append(out.filter(F.col("kind") == tasks.MOVE).count())
        return out

    monkeypatch.setattr(Scratch, "write", spy)
    out = replay(moves)
    state, log = play([r[1:] for r in rows])
    assert {(r.x, r.y): (r.id, r.uid, r.bid) for r in out.final.collect()} == {
        c: s for c, s in state.items()
    }
    assert {r.id: (r.outcome, r.captured, r.merged) for r in out.log.collect()} == log
    assert sum(seen) < len(rows) / 3


def test_scratch_uses_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    scratch = Scratch(spark)
    assert scratch.write(spark.range(3), "numbers").count() == 3
    assert scratch.root.startswith(shared_dir(spark))
    scratch.discard()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{scratch.root}/0001-numbers").count()
