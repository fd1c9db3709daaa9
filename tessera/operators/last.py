"""Operators around the last stone of each board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import neighbours
from tessera.operators.ingest import CELL


def last_stone(df: DataFrame) -> DataFrame:
    """Per board the stone with the greatest ``id``."""
    rest = [c for c in df.columns if c not in ("board_id", "id")]
    top = df.groupBy("board_id").agg(
        F.max("id").alias("id"), *[F.max_by(c, "id").alias(c) for c in rest]
    )
    return top.select(*df.columns)


def adjoining(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The last stone of each board and the stones on its four sides."""
    at = neighbours((last or last_stone(df)).select(*CELL), n=5)
    return df.join(at, CELL, "left_semi")


def open_sides(df: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Number of empty cells around the last stone of each board."""
    at = neighbours((last or last_stone(df)).select(*CELL))
    taken = df.select(*CELL, F.lit(1).alias("_t"))
    return (
        at.join(taken, CELL, "left")
        .groupBy("board_id")
        .agg((F.lit(4) - F.count("_t")).cast("long").alias("open_sides"))
    )


def related_blocks(df: DataFrame) -> DataFrame:
    """Distinct blocks among the adjoining stones, ``side`` own or enemy."""
    last = last_stone(df)
    owner = last.select("board_id", F.col("uid").alias("_last_uid"))
    return (
        adjoining(df, last)
        .select("board_id", "bid", "uid")
        .distinct()
        .join(owner, "board_id")
        .select(
            "board_id",
            "bid",
            "uid",
            F.when(F.col("uid") == F.col("_last_uid"), "own").otherwise("enemy").alias("side"),
        )
    )


def related_except_own(df: DataFrame) -> DataFrame:
    """Enemy blocks as a set difference: all related blocks less the own ones."""
    related = related_blocks(df)
    own = related.filter("side = 'own'").select("board_id", "bid")
    return related.select("board_id", "bid").subtract(own)


def last_move_env(moves: DataFrame) -> DataFrame:
    """Settings table per board as ``name,value`` rows: start time, last move."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    last = moves.groupBy("board_id").agg(
        F.min("ts").alias("_t0"),
        *[F.max_by(c, "id").alias(f"_{c}") for c in ("ts", "x", "y", "uid")],
    )
    return last.select(
        "board_id",
        F.expr(
            "stack(5, 'system_start_time', date_format(_t0, '{0}'), "
            "'last_go_time', date_format(_ts, '{0}'), 'last_x', cast(_x as string), "
            "'last_y', cast(_y as string), 'last_uid', cast(_uid as string))"
            " as (name, value)".format(stamp)
        ),
    )


def env_long(env: DataFrame, name: str) -> DataFrame:
    """Read one numeric setting back per board."""
    return env.filter(F.col("name") == name).select(
        "board_id", F.col("value").cast("long").alias(name)
    )
