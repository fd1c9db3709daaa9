"""The stream jobs run to the end of the available test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import CELL
from tessera.plans import boards
from tessera.schema import EVENTS
from tessera.scratch import Scratch
from tessera.streaming import keyed
from tessera.streaming.jobs import (
    current_stones,
    replay_log,
    start_replay,
    stream_idle,
    stream_ingest,
    stream_rejects,
)


def ingest_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_ingest`` over all JSON moves of the test tables."""
    scratch = Scratch(spark)
    out = scratch.path("ingest")
    stream = stream_ingest(boards.moves_json_of(boards.event_stream(spark, sf_dir)))
    schema = stream.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", scratch.path("ingest-checkpoint"))
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = spark.read.schema(schema).parquet(out)
    return updates.groupBy(*CELL).agg(
        F.min("id").alias("id"), F.min_by("uid", "id").alias("uid")
    )


def idle_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_idle`` over the replay moves of the test tables."""
    scratch = Scratch(spark)
    out = scratch.path("idle")
    sessions = stream_idle(boards.replay_moves_of(boards.event_stream(spark, sf_dir)))
    query = (
        sessions.writeStream.outputMode("append")
        .option("checkpointLocation", scratch.path("idle-checkpoint"))
        .format("parquet")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(sessions.schema).parquet(out)


def rejects_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_rejects`` over all JSON moves of the test tables."""
    scratch = Scratch(spark)
    out = scratch.path("rejects")
    refused = stream_rejects(boards.moves_json_of(boards.event_stream(spark, sf_dir)))
    query = (
        refused.writeStream.option("checkpointLocation", scratch.path("rejects-checkpoint"))
        .format("parquet")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(refused.schema).parquet(out).select("board_id", "id", "code", "reason")


def _fed(spark: SparkSession, sf_dir: str, runs: int, run) -> None:
    """Call ``run`` with a stream of all events so far, each time after a further share of them,
    in ascending id, was written: every run is a restart that reads the new files."""
    source = Scratch(spark).path("source")
    top = boards.events(spark, sf_dir).agg(F.max("event_id")).first()[0] or 0
    for k in range(runs):
        low, high = (top + 1) * k // runs, (top + 1) * (k + 1) // runs
        part = boards.events(spark, sf_dir).filter(F.col("event_id").between(low, high - 1))
        part.write.mode("append").parquet(source)
        run(spark.readStream.schema(EVENTS).parquet(source)).awaitTermination()


def _played(spark: SparkSession, sf_dir: str, epochs: int) -> str:
    """Replay all events in ``epochs`` micro-batches of ascending id; the folder of results."""
    scratch = Scratch(spark)
    root, checkpoint = scratch.path("replay"), scratch.path("replay-checkpoint")

    def run(events: DataFrame):
        return start_replay(boards.replay_moves_of(events), root, checkpoint, compact_every=2)

    if epochs > 1:
        _fed(spark, sf_dir, epochs, run)
    else:
        run(boards.event_stream(spark, sf_dir)).awaitTermination()
    return root


def replay_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``start_replay`` over the replay moves of the test tables; its log."""
    log = replay_log(spark, _played(spark, sf_dir, 1))
    return log.withColumn("merged", F.col("merged").cast("long"))


def replay_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in five micro-batches, each on the stones that earlier ones left."""
    log = replay_log(spark, _played(spark, sf_dir, 5))
    return log.withColumn("merged", F.col("merged").cast("long"))


def replay_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stones after three micro-batches, with their labels."""
    return current_stones(spark, _played(spark, sf_dir, 3)).select(
        "board_id", "id", "x", "y", "bid", "uid"
    )


def _keyed(
    spark: SparkSession, sf_dir: str, runs: int, moves_of, walls=None, reset=None
) -> tuple[str, str]:
    """Play all events as keyed state in several runs; the folders of events and state."""
    scratch = Scratch(spark)
    out, checkpoint = scratch.path("play"), scratch.path("play-checkpoint")
    _fed(spark, sf_dir, runs, lambda events: keyed.start_play(moves_of(events), out, checkpoint, walls, reset))
    return out, checkpoint


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes that keyed state gives, over three runs from one checkpoint."""
    out, _ = _keyed(spark, sf_dir, 3, boards.replay_moves_of)
    log = keyed.play_log(keyed.play_events(spark, out))
    return log.withColumn("merged", F.col("merged").cast("long"))


def keyed_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled stones in the state store after two runs."""
    _, checkpoint = _keyed(spark, sf_dir, 2, boards.replay_moves_of)
    return keyed.play_stones(spark, checkpoint)


def keyed_hot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same games side by side on one board: its walled zones are the keys."""
    out, _ = _keyed(spark, sf_dir, 2, boards.zoned_moves_of, walls=(-1, 19))
    log = keyed.play_log(keyed.play_events(spark, out))
    return log.withColumn("merged", F.col("merged").cast("long"))


RESET = keyed.IdleReset(0, 2, 43_200)
"""Half a day without a move of its player clears a quarter of a board."""


def keyed_reset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle resets within the games: cells come free again, blocks are cut and keep their label."""
    out, _ = _keyed(spark, sf_dir, 2, boards.replay_moves_of, reset=RESET)
    log = keyed.play_log(keyed.play_events(spark, out))
    return log.withColumn("merged", F.col("merged").cast("long"))


def keyed_reset_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stones that games with resets leave, with their labels."""
    _, checkpoint = _keyed(spark, sf_dir, 2, boards.replay_moves_of, reset=RESET)
    return keyed.play_stones(spark, checkpoint)
