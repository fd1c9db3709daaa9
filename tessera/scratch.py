"""Intermediate tables that cut lineage and survive the loss of executors.

Iterative jobs write each step as a parquet table in the shared folder that the
session names in ``spark.checkpoint.dir`` and read it back.  Compared with an
in-memory cut the table outlives any executor, is column-pruned on re-read, and its
known size lets Spark choose broadcast or shuffle joins from facts.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_CLEANED: set[str] = set()
_SHIPPED: set[str] = set()
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as named by the session.

    Only a ``local`` master without the setting gets a temporary folder; a cluster
    without it is an error, since no machine-local folder is visible to all nodes.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all nodes can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL_DIRS[app]


class Scratch:
    """Names and writes the intermediate tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
        self.root = f"{base}/{uuid.uuid4().hex}"
        self._n = 0
        if base not in _CLEANED:
            folder, fs = self._folder(base)
            fs.mkdirs(folder)
            fs.deleteOnExit(folder)
            _CLEANED.add(base)
        self._ship(f"{base}/tessera.zip")

    def _ship(self, path: str) -> None:
        """Give the executors this package, once for each application: tasks import it, and
        only the driver may have it on its path."""
        context = self.spark.sparkContext
        home = os.path.dirname(os.path.abspath(__file__))
        if context.applicationId in _SHIPPED or not os.path.isdir(home):
            return
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in sorted(os.walk(home)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    inside = os.path.relpath(os.path.join(folder, name), os.path.dirname(home))
                    archive.write(os.path.join(folder, name), inside)
        at, fs = self._folder(path)
        out = fs.create(at, True)
        out.write(packed.getvalue())
        out.close()
        context.addPyFile(fs.makeQualified(at).toString())
        _SHIPPED.add(context.applicationId)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Materialise ``df`` and return a frame that reads the written table.

        The shuffle files of the write go with it, as nothing reads them again.  With ``by``
        each value of that column is a folder, which ``part`` reads and ``drop`` can delete.
        """
        path = self.path(name)
        before = self.spark.conf.get(_CLEAN_UP)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self, table: DataFrame, by: str, value: int) -> DataFrame:
        """The rows of one folder of a table written ``by`` a column."""
        there = [f.rsplit("/", 1)[0] for f in table.where(F.col(by) == value).inputFiles()]
        there = sorted({f for f in there if f.endswith(f"/{by}={value}")})
        schema = table.drop(by).schema
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*there)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned and nothing reads any more."""
        for table in tables:
            for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
                folder, fs = self._folder(path)
                fs.delete(folder, True)

    def discard(self) -> None:
        """Delete this job's own intermediate tables; call when nothing reads them."""
        folder, fs = self._folder(self.root)
        fs.delete(folder, True)

    def _folder(self, path: str):
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())


def lookup_table(df: DataFrame, name: str = "lookup", scratch: Scratch | None = None) -> DataFrame:
    """Write a table of unique keys that rows with possibly hot keys will look up.

    Joined as it stands, an aggregate shares its shuffle with the join, and Spark
    then cannot split the other side's hot partitions.  Read back from storage it
    has a shuffle of its own, so adaptive execution splits them, and its known size
    decides whether it is broadcast instead.
    """
    return (scratch or Scratch(df.sparkSession)).write(df, name)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input, by shuffle.

    Spark would gather the smaller one on the driver to broadcast it as long as its files are
    below a limit, each of many joins anew, and compressed files say little about its size in
    memory.  So joined nothing passes the driver, and hot partitions are still split.
    """
    return left.join(right.hint("merge"), on, how)
