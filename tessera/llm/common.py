"""Helpers that the operators share: rows, order, Arrow batches, files that tasks write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.scratch import Scratch

BATCH_ROWS = 512
"""Rows of an Arrow batch of whole texts: bounds what a Python worker holds."""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold few rows (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_key(name: str) -> Column:
    """An id as a key that joins also where it is null: joins and windows on it share one
    shuffle, which null-safe comparisons do not."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def folder(scratch: Scratch, name: str) -> str:
    """A new folder of the shared scratch space as a URI that tasks can open."""
    path = scratch.path(name)
    at, fs = scratch._folder(path)
    fs.mkdirs(at)
    return fs.makeQualified(at).toString()


def open_uri(uri: str):
    """The file system of a URI and the path on it, also inside tasks."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(kind: str) -> str:
    """A file name for this attempt of this task. A retried or speculative attempt gets
    another one; readers go by the manifest, which lists committed attempts only."""
    from pyspark import TaskContext

    return f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{kind}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the few rows of a work list to as many tasks as a shuffle has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def ordered(scratch: Scratch, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Write ``df`` in global order, with ``_part`` (its range) and ``_at`` (place in it).

    Range partitioning bounds what a task sorts; the written numbers are stable for
    everything that reads them.
    """
    at = F.monotonically_increasing_id()
    table = scratch.write(df.orderBy(*order).withColumn("_m", at), name)
    low = F.lit((1 << 33) - 1)
    return table.withColumns(
        {"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(low)}
    ).drop("_m")


def all_parts() -> Window:
    """Over one row for each written range: as many rows as the table had partitions."""
    return Window.orderBy("_part")
