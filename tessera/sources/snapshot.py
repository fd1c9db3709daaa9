"""Stone snapshots on storage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.geometry import tile_of
from tessera.schema import STONES


def load_stones(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stone snapshot with the fixed schema."""
    return spark.read.schema(STONES).parquet(path)


def export_snapshot(df: DataFrame, root: str, ts: dt.datetime) -> str:
    """Write a copy of the stone table under a ``%Y%m%d-%H%M%S`` folder.

    Rows are range-partitioned by board and tile, so a hot board spreads over many
    files and the row-group statistics prune board and box filters.  The target
    must not exist.  Returns the folder written.
    """
    path = f"{root.rstrip('/')}/{ts.strftime('%Y%m%d-%H%M%S')}"
    (
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in STONES])
        .repartitionByRange("board_id", tile_of("x"), tile_of("y"))
        .sortWithinPartitions("board_id", "x", "y")
        .write.parquet(path)
    )
    return path
