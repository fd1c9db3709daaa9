"""Exact duplicates by a persistent index of text digests.

The index is a bucketed table, sorted by digest within buckets.  A batch of new documents
is reduced to its digests, those that the index has are left out by a sort-merge anti-join
in which the index is neither shuffled nor sorted, and the rest is appended.
"""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import folder, id_key, open_uri, text_or_empty
from tessera.scratch import Scratch, lookup_table

BUCKETS = 16
"""Buckets at least; each append gathers its digests in as many tasks."""
BUCKET_ROWS = 20_000_000
"""Digests that a bucket should hold, by which a new index chooses their number."""
SPACE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``digest``: the SHA-256 of the text with runs of white space as one
    space.  Null texts count as empty."""
    plain = F.regexp_replace(text_or_empty(), SPACE, " ")
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(plain, 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, with the document that keeps each, at a place of its own.

    The folder outlives the session: opened again at the same place, the index goes on
    where it was, with the number of buckets it was made with, which is kept beside it.  A
    new one has enough buckets for the ``expected`` number of digests.
    """

    def __init__(self, spark: SparkSession, place: str, expected: int = 0):
        self.spark, self.place = spark, place
        self.buckets = buckets = self._known() or self._note(
            max(BUCKETS, 1 << max(0, -(-expected // BUCKET_ROWS) - 1).bit_length())
        )
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def _known(self) -> int | None:
        fs, folder_ = open_uri(self.place)
        there = fs.get_file_info(FileSelector(folder_, allow_not_found=True))
        names = [f.base_name for f in there if f.base_name.startswith("_buckets_")]
        return int(names[0].rpartition("_")[2]) if names else None

    def _note(self, buckets: int) -> int:
        fs, folder_ = open_uri(self.place)
        fs.create_dir(folder_)
        with fs.open_output_stream(f"{folder_}/_buckets_{buckets}") as out:
            out.write(b"")
        return buckets

    def rewritten(self, place: str, expected: int) -> DigestIndex:
        """The same digests in a new index, with buckets for the ``expected`` number."""
        made = DigestIndex(self.spark, place, expected)
        made.append(self.plain().withColumnRenamed("keep_id", "doc_id"))
        return made

    def bucketed(self) -> DataFrame:
        return self.spark.table(self.table)

    def plain(self) -> DataFrame:
        """The same rows without their buckets: for joins with rows whose digests may be
        hot, which need a shuffle that adaptive execution can split."""
        return self.spark.read.schema("digest BINARY, keep_id BIGINT").parquet(self.place)

    def append(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (``doc_id``, ``digest``) that are new.

        Counted together first, a popular digest is one row when it meets the index.
        Appending the same batch again adds nothing.
        """
        new = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        seen = self.bucketed().select("digest")
        fresh = new.repartition(self.buckets, "digest").join(
            seen.hint("merge"), "digest", "left_anti"
        )
        (
            fresh.write.format("parquet").mode("append")
            .option("path", self.place)
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.table)
        )

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")


def index_documents(
    docs: DataFrame, scratch: Scratch | None = None, batches: int = 2, place: str | None = None
) -> DataFrame:
    """A row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Documents enter the index in ``batches`` of ascending ``doc_id``, as a growing corpus
    would; of equal texts the smallest ``doc_id`` stays.  Rows without ``doc_id`` come last
    and are kept only where no equal text has one (``keep_id`` is then null).  Of rows that
    repeat both ``doc_id`` and text one is kept.  Null and empty texts are one text.  An
    empty table gives no row; further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    counted = scratch.write(
        digests(docs).groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "digests"
    )
    index = DigestIndex(docs.sparkSession, place or folder(scratch, "index"), counted.count())
    shares = [k / batches for k in range(1, batches)]
    cuts = counted.approxQuantile("doc_id", shares, 0.01) if shares else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    for low, high in zip(edges, edges[1:]):
        batch = counted.where("doc_id IS NOT NULL")
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        index.append(batch if high is None else batch.where(F.col("doc_id") <= high))
    index.append(counted.where("doc_id IS NULL"))
    sizes = counted.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    found = lookup_table(index.plain().join(sizes, "digest"), "found", scratch)
    index.close()
    rows = counted.join(found, "digest").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with all their columns, one row of each group of equal texts."""
    scratch = scratch or Scratch(docs.sparkSession)
    decided = index_documents(docs, scratch, **options).where("kept")
    keep = lookup_table(
        decided.select(id_key("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")),
        "keep", scratch,
    )
    plain = F.regexp_replace(text_or_empty(), SPACE, " ")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        id_key("doc_id").alias("_id"), F.unhex(F.sha2(plain, 256)).alias("_digest"),
    )
    first = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_id"))
    return rows.join(keep.hint("merge"), ["_id", "_digest"]).withColumn("_n", first).where("_n = 1").select("_row.*")
