"""Structured Streaming jobs: ingest, idle sessions, ordered replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.clock import whole_seconds
from tessera.operators.blocks import label_blocks
from tessera.operators.ingest import CELL, constraint_reason
from tessera.plans.replay import replay
from tessera.schema import IDLE_SECONDS
from tessera.scratch import Scratch, lookup_table
from tessera.sources.wire import parse_moves

_KEY = ["board_id", "id"]


def stream_ingest(json_stream: DataFrame) -> DataFrame:
    """Parse, validate, and keep the first writer of each cell.

    An update-mode aggregate: attempts are combined before the shuffle, so a popular
    cell costs one row per task, and the state is one row per occupied cell.  Each
    micro-batch emits the owner of every cell it touches; a later row for the same
    cell repeats it, or replaces it if a smaller ``id`` arrived late, so the sink
    upserts by cell.  Exact while no capture frees a cell; ``start_replay`` decides
    with captures.
    """
    good = parse_moves(json_stream).filter("code = 0").filter(constraint_reason().isNull())
    return good.groupBy(*CELL).agg(F.min("id").alias("id"), F.min_by("uid", "id").alias("uid"))


def stream_rejects(json_stream: DataFrame) -> DataFrame:
    """The records ``stream_ingest`` refuses, with a reason; stateless."""
    parsed = parse_moves(json_stream)
    reason = F.when(F.col("code") != 0, "not a move").otherwise(constraint_reason())
    return parsed.withColumn("reason", reason).filter("reason is not null")


def stream_idle(
    moves: DataFrame, key: str = "board_id", threshold: int = IDLE_SECONDS, delay: str = "0 seconds"
) -> DataFrame:
    """Sessions ``key, started, ended, moves`` closed by ``threshold`` idle seconds.

    Session windows merge events exactly one gap apart, so the gap is one second
    less on whole seconds.  Append mode; rows later than ``delay`` are dropped and
    the open session is not emitted.  For hot keys set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    at = F.timestamp_seconds(whole_seconds(F.col("ts")))
    return (
        moves.select(key, at.alias("_at"))
        .withWatermark("_at", delay)
        .groupBy(key, F.session_window("_at", f"{threshold - 1} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("moves"))
        .select(
            key,
            F.unix_timestamp("_w.start").alias("started"),
            (F.unix_timestamp("_w.end") - (threshold - 1)).alias("ended"),
            "moves",
        )
    )


_STONE = "board_id long, id long, x long, y long, uid long"


BUCKETS = 64
COMPACT_EVERY = 20


def _tail(spark: SparkSession, root: str, name: str, schema: str, first: int, epoch: int) -> DataFrame:
    """What the epochs from ``first`` and before ``epoch`` wrote; older folders aren't read."""
    table = spark.read.schema(f"{schema}, epoch long").parquet(f"{root}/{name}")
    return table.filter(F.col("epoch").between(first, epoch - 1)).drop("epoch")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("board_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _snapshot_at(epoch: int, every: int) -> int:
    """The newest snapshot an epoch can read: it holds what the epochs before it left."""
    return epoch // every * every


def _stones_before(
    spark: SparkSession, root: str, epoch: int, every: int, buckets: list[int] | None = None
) -> DataFrame:
    """The stones that the epochs before ``epoch`` left: the newest snapshot, of which only
    the folders of ``buckets`` are read, and the epochs since."""
    base = _snapshot_at(epoch, every)
    placed = _tail(spark, root, "placed", _STONE, base, epoch)
    removed = _tail(spark, root, "removed", _STONE, base, epoch).select(*_KEY)
    if base:
        kept = spark.read.schema(f"{_STONE}, bucket int").parquet(f"{root}/stones/epoch={base}")
        if buckets is not None:
            kept = kept.filter(F.col("bucket").isin(buckets))
        placed = kept.drop("bucket").unionByName(placed)
    return placed.join(removed, _KEY, "left_anti")


def _last_before(
    spark: SparkSession, root: str, epoch: int, every: int, buckets: list[int] | None = None
) -> DataFrame:
    """The last applied id of every board."""
    base = _snapshot_at(epoch, every)
    schema = "board_id long, id long"
    last = _tail(spark, root, "last", schema, base, epoch)
    if base:
        kept = spark.read.schema(f"{schema}, bucket int").parquet(f"{root}/ids/epoch={base}")
        if buckets is not None:
            kept = kept.filter(F.col("bucket").isin(buckets))
        last = kept.drop("bucket").unionByName(last)
    return last.groupBy("board_id").agg(F.max("id").alias("id"))


def _compact(spark: SparkSession, root: str, epoch: int, every: int) -> None:
    """Write the snapshot of an epoch from the one before and the epochs since.  Running it
    again overwrites it with the same rows."""
    before = epoch - every
    base = {"stones": _STONE, "ids": "board_id long, id long"}
    placed = _tail(spark, root, "placed", _STONE, before, epoch)
    removed = _tail(spark, root, "removed", _STONE, before, epoch).select(*_KEY)
    last = _tail(spark, root, "last", base["ids"], before, epoch)
    if before:
        old = {
            n: spark.read.schema(f"{s}, bucket int").parquet(f"{root}/{n}/epoch={before}").drop("bucket")
            for n, s in base.items()
        }
        placed, last = old["stones"].unionByName(placed), old["ids"].unionByName(last)
    now = {
        "stones": placed.join(removed, _KEY, "left_anti"),
        "ids": last.groupBy("board_id").agg(F.max("id").alias("id")),
    }
    for name, rows in now.items():
        rows.select("*", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{root}/{name}/epoch={epoch}"
        )


def replay_batch(moves: DataFrame, epoch: int, root: str, every: int = COMPACT_EVERY) -> None:
    """Play one micro-batch on the stones left by the epochs before it.

    Writes what changed under ``root``: ``placed`` and ``removed`` stones, the last
    id per board (``last``) and the outcome of every move (``log``), each in a
    folder of its epoch.  Running an epoch again overwrites the same folders.  Rows
    of a micro-batch need no order; a move not above its board's last applied id is
    rejected as late.

    Every ``every`` epochs all stones and last ids are written in buckets of boards, so a
    micro-batch reads the buckets of its own boards and fewer than ``every`` epochs, however
    long the stream has run.  ``every`` must stay the same for one ``root``.
    """
    spark = moves.sparkSession
    scratch = Scratch(spark)
    moves = scratch.write(moves.select(*_KEY, "x", "y", "uid"), "batch")
    late, state = moves.limit(0), None
    if epoch > 0:
        if epoch % every == 0:
            _compact(spark, root, epoch, every)
        touched = lookup_table(moves.select("board_id").distinct(), "touched", scratch)
        buckets = [r.bucket for r in touched.select(_bucket()).distinct().collect()]
        last = lookup_table(
            _last_before(spark, root, epoch, every, buckets)
            .join(touched, "board_id", "left_semi")
            .withColumnRenamed("id", "_last"),
            "last", scratch,
        )
        judged = scratch.write(moves.join(last, "board_id", "left"), "judged")
        late = judged.filter("id <= _last").drop("_last")
        moves = judged.filter("_last is null or id > _last").drop("_last")
        state = scratch.write(
            _stones_before(spark, root, epoch, every, buckets)
            .join(touched, "board_id", "left_semi")
            .withColumn("bid", F.col("id")),
            "state",
        )
    out = replay(moves, state, scratch=scratch)
    final = out.state.drop("bid")
    placed, removed = final, final.limit(0)
    if state is not None:
        placed = final.join(state.select(*_KEY), _KEY, "left_anti")
        removed = state.drop("bid").join(final.select(*_KEY), _KEY, "left_anti")
    refused = late.select(
        *_KEY, "x", "y", "uid", F.lit("late").alias("outcome"),
        F.lit(0).cast("long").alias("captured"), F.lit(False).alias("merged"),
    )
    columns = [*_KEY, "x", "y", "uid"]
    for name, rows in {
        "placed": placed.select(*columns),
        "removed": removed.select(*columns),
        "last": moves.groupBy("board_id").agg(F.max("id").alias("id")),
        "log": out.log.unionByName(refused),
    }.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")
    scratch.discard()


def start_replay(
    moves: DataFrame,
    root: str,
    checkpoint: str,
    available_now: bool = True,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Replay a stream of moves; each micro-batch is one distributed ``replay``.

    State lives in the tables under ``root``, not in one task per board, so a board
    with a large share of the stream is split like any other.
    """
    writer = (
        moves.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, epoch: replay_batch(batch, epoch, root, compact_every))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_stones(spark: SparkSession, root: str) -> DataFrame:
    """The labelled stones after all epochs so far."""
    placed = spark.read.schema(f"{_STONE}, epoch long").parquet(f"{root}/placed")
    removed = spark.read.schema(f"{_STONE}, epoch long").parquet(f"{root}/removed")
    return label_blocks(placed.drop("epoch").join(removed.select(*_KEY), _KEY, "left_anti"))


def replay_log(spark: SparkSession, root: str) -> DataFrame:
    """All outcomes so far."""
    schema = f"{_STONE}, outcome string, captured long, merged boolean, epoch long"
    return spark.read.schema(schema).parquet(f"{root}/log").drop("epoch")
