"""Token ids in compressed shards that share one zstandard dictionary.

A shard holds a header, one zstandard frame for each document, an index and a footer:

    header   magic, id width in bytes, SHA-256 of the dictionary
    frames   the ids of one document each, little-endian, compressed with the dictionary
    index    zstandard frame of: doc ids, their validity, frame ends, id counts
    footer   place and size of the index, number of documents, magic

A document is read with two ranged reads, one of the index and one of its frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import attempt_name, folder, open_uri, small_batches, spread, text_or_empty
from tessera.scratch import Scratch

MAGIC = b"TESSIDS1"
HEADER, FOOTER = "<8sI32s", "<QQQ8s"
DICTIONARY_BYTES = 1 << 16
DICTIONARY_DOCS = 256
DICTIONARY_IDS = 1 << 14
"""The dictionary is trained on at most so many documents, so many characters and ids of each,
from a place in the text that a hash chooses."""
READ_DOCS = 2048


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; empty where the samples are too few to train one."""
    import zstandard

    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compression(dictionary: bytes):
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _writer(path: str, end_id: int, width: int, root: str, dictionary: bytes):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder = tokens.encoder(path)
        compress = zstandard.ZstdCompressor(level=3, **_compression(dictionary)).compress
        end = np.array([end_id], dtype="<u4")
        doc_ids, valid, ends, counts = [], [], [], []
        out = uri = None
        at = struct.calcsize(HEADER)
        for batch in batches:
            encoded = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                if out is None:
                    uri = f"{root}/{attempt_name('tids')}"
                    fs, file = open_uri(uri)
                    out = fs.open_output_stream(file, compression=None)
                    out.write(struct.pack(HEADER, MAGIC, width, hashlib.sha256(dictionary).digest()))
                ids = np.concatenate([ids, end])
                frame = compress(_serialized(ids, width))
                out.write(frame)
                at += len(frame)
                doc_ids.append(doc_id or 0)
                valid.append(doc_id is not None)
                ends.append(at)
                counts.append(len(ids))
        if out is None:
            return
        index = zstandard.compress(
            np.array(doc_ids, "<i8").tobytes() + np.array(valid, "u1").tobytes()
            + np.array(ends, "<u8").tobytes() + np.array(counts, "<u4").tobytes()
        )
        out.write(index + struct.pack(FOOTER, at, len(index), len(ends), MAGIC))
        out.close()
        row = {"part": [TaskContext.get().partitionId()], "uri": [uri], "docs": [len(ends)],
               "ids": [sum(counts)], "bytes": [at + len(index) + struct.calcsize(FOOTER)]}
        yield pa.RecordBatch.from_pydict(row)

    return run


def _windows(rows: DataFrame) -> list[str]:
    """Windows of texts to train the dictionary on: of the documents with the smallest hashes,
    which a share that fits the number of rows picks before anything is sent."""
    mark = F.xxhash64("doc_id", "text")
    share = min(1.0, 4 * DICTIONARY_DOCS / max(rows.count(), 1))
    few = rows.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    room = F.greatest(F.length("text") - DICTIONARY_IDS + 1, F.lit(1))
    start = F.pmod(F.xxhash64(mark), room).cast("int") + 1
    cut = few.select(mark.alias("mark"), F.substring("text", start, F.lit(DICTIONARY_IDS)).alias("cut"))
    return [r.cut for r in cut.orderBy("mark", "cut").limit(DICTIONARY_DOCS).collect()]


def write_shards(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    width: int = 4,
) -> DataFrame:
    """Encode ``docs`` and write shards in ascending ``doc_id`` order (nulls first, ties by
    a hash of the text).  Returns the manifest: a row for each committed shard, with the
    number of ids before it.  The dictionary lies beside the shards, named by its hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path or tokens.default_path()
    root = folder(scratch, "shards")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    encoder = tokens.encoder(path)
    dictionary = train_dictionary(
        [_serialized(ids[:DICTIONARY_IDS], width) for ids in encoder.encode(_windows(rows)) if len(ids)]
    )
    fs, file = open_uri(f"{root}/{hashlib.sha256(dictionary).hexdigest()}.zdict")
    with fs.open_output_stream(file, compression=None) as out:
        out.write(dictionary)
    # The text's hash also divides the rows of one id, or of none.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    in_order = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    manifest = scratch.write(
        in_order.mapInArrow(
            _writer(path, end_id, width, root, dictionary),
            "part long, uri string, docs long, ids long, bytes long",
        ),
        "manifest",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Shard:
    """Ranged reads of one shard; checks the dictionary against the hash in the header."""

    def __init__(self, uri: str):
        import zstandard

        fs, file = open_uri(uri)
        self.file = fs.open_input_file(file)
        size = self.file.size()
        at, length, self.docs, magic = struct.unpack(
            FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER))
        )
        head, self.width, digest = struct.unpack(
            HEADER, self.file.read_at(struct.calcsize(HEADER), 0)
        )
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        fs, file = open_uri(f"{uri.rpartition('/')[0]}/{digest.hex()}.zdict")
        with fs.open_input_file(file) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {uri} has changed")
        raw, n = zstandard.decompress(self.file.read_at(length, at)), self.docs
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.valid = np.frombuffer(raw, "u1", n, 8 * n)
        ends = np.frombuffer(raw, "<u8", n, 9 * n)
        self.ends = np.concatenate([[struct.calcsize(HEADER)], ends]).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u4", n, 17 * n).astype(np.int64)
        self._decompress = zstandard.ZstdDecompressor(**_compression(dictionary)).decompress

    def read(self, first: int, count: int):
        """Place and ids of documents ``first`` to ``first + count``."""
        last = min(first + count, self.docs)
        base = int(self.ends[first])
        data = self.file.read_at(int(self.ends[last]) - base, base)
        for k in range(first, last):
            frame = data[int(self.ends[k]) - base : int(self.ends[k + 1]) - base]
            ids = np.frombuffer(self._decompress(frame), f"<u{self.width}")
            if len(ids) != self.counts[k]:
                raise ValueError(f"document {k} has {len(ids)} ids, its index {self.counts[k]}")
            yield k, ids


def _reader(batches):
    import pyarrow as pa

    shard = at = None
    for batch in batches:
        for row in batch.to_pylist():
            if at != row["uri"]:
                shard, at = Shard(row["uri"]), row["uri"]
                starts = np.concatenate([[0], np.cumsum(shard.counts)])
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for k, ids in shard.read(row["first"], READ_DOCS):
                out["doc_id"].append(int(shard.doc_ids[k]) if shard.valid[k] else None)
                out["start"].append(row["before"] + int(starts[k]))
                out["n_tokens"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.int64()) for n in out]))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Each document as its shard has it: ``doc_id``, ``start`` (ids of all documents
    before), ``n_tokens`` and the CRC-32 of its ids.  Tasks read ranges of documents."""
    last = F.greatest(F.col("docs") - 1, F.lit(0))
    work = manifest.select(
        "uri", "before", F.explode(F.sequence(F.lit(0), last, F.lit(READ_DOCS))).alias("first")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return spread(work, "uri", "first").mapInArrow(_reader, schema)


def token_shards(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) as shards and read them back.

    Null and empty texts consist of the end id alone; rows without ``doc_id`` come first;
    repeated rows stay repeated; an empty table gives no shard and no row; further columns
    are ignored.  A retried task writes another file, and only files of committed tasks
    are in the manifest.
    """
    return read_shards(write_shards(docs, scratch or Scratch(docs.sparkSession), **options))
