"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  A reading task owns a byte range of a file:
it looks for gzip magic, accepts a place as the start of a member only if the bytes there
inflate to the head of a record, and reads the records that start inside its range, to
their ends, also beyond the range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import attempt_name, folder, id_key, open_uri, small_batches, spread, text_or_empty
from tessera.scratch import Scratch, lookup_table

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 1 << 22
BLOCK = 1 << 16
SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string"
)


def _safe(value: str) -> str:
    """Header values hold no line ends."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def _member(head: list[tuple[str, object]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(body))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n")
    return made + packer.flush()


def record(page_id, url, payload: bytes, digest: str, copy: int, original, refers_to) -> bytes:
    """One record; ``original`` says whether the payload is kept in it."""
    head = [
        ("WARC-Type", "response" if original else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest, copy)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if not original:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, digest, 1)),
        ]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", refers_to))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _member(head, http.encode() + (payload if original else b""))


def _writer(root: str):
    def run(batches):
        import pyarrow as pa

        out = uri = None
        size = records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri = f"{root}/{attempt_name('warc.gz')}"
                    fs, file = open_uri(uri)
                    out = fs.open_output_stream(file, compression=None)
                    size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: tessera\r\n"))
                digest = base64.b32encode(bytes(row["_sha1"])).decode()
                size += out.write(
                    record(row["page_id"], row["url"], row["html"].encode(), digest,
                           row["_copy"], row["_original"], row["_largest"])
                )
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [size], "records": [records]})

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``).

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest
    ``page_id`` becomes the response, the others revisit it.  Returns the manifest of
    committed files.  Which payloads are equal is found on digests alone; pages are
    shuffled once, by ``page_id``, so a popular payload meets in no task.
    """
    small_batches(pages.sparkSession)
    keyed = pages.select(
        F.col("page_id").cast("long"), "url", text_or_empty("html").alias("html")
    ).withColumns({"_key": id_key("page_id"), "_sha1": F.unhex(F.sha1(F.encode("html", "utf-8")))})
    largest = lookup_table(
        keyed.groupBy("_sha1").agg(F.max("page_id").alias("_largest")), "largest", scratch
    )
    rows = keyed.select("_key", "_sha1").distinct()
    decided = lookup_table(rows.join(largest, "_sha1"), "decided", scratch)
    copy = F.row_number().over(Window.partitionBy("_key", "_sha1").orderBy("url"))
    original = (F.octet_length("html") < least_bytes) | (
        F.col("page_id").eqNullSafe(F.col("_largest")) & (F.col("_copy") == 1)
    )
    work = keyed.join(decided.hint("merge"), ["_key", "_sha1"]).withColumn("_copy", copy).withColumn("_original", original)
    chosen = work.select("page_id", "url", "html", "_sha1", "_copy", "_original", "_largest")
    schema = "uri string, bytes long, records long"
    return scratch.write(chosen.mapInArrow(_writer(folder(scratch, "warc")), schema), "manifest")


class Source:
    """Forward reads of a file from any place, block by block."""

    def __init__(self, uri: str):
        fs, path = open_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def block(self, at: int, n: int = BLOCK) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)


def head_at(source: Source, at: int):
    """(fields, inflater, inflated rest of the head's blocks, next place) of the record
    whose member starts at ``at``; None if no record does.  A head may be of any length, as
    it holds the whole url; what does not begin like one is refused at once."""
    inflate, text, place, seen = zlib.decompressobj(31), bytearray(), at, 0
    while text.find(b"\r\n\r\n", seen) < 0:
        seen = max(0, len(text) - 3)
        data = source.block(place, BLOCK if place > at else 2048)
        if not data or inflate.eof:
            return None
        try:
            text += inflate.decompress(data)
        except zlib.error:
            return None
        place += len(data)
        if not b"WARC/1.".startswith(bytes(text[:7])):
            return None
    head, _, rest = bytes(text).partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return None
    return fields, inflate, rest, place


def record_at(source: Source, at: int):
    """(fields, body, place after the member) of the record that starts at ``at``, else
    None: the whole member must inflate, with a right check sum and length."""
    got = head_at(source, at)
    if got is None:
        return None
    fields, inflate, body, place = got
    parts, want = [body], int(fields["content-length"]) + 4
    size = len(body)
    try:
        while not inflate.eof:
            data = source.block(place)
            if not data or size > want:
                return None
            place += len(data)
            parts.append(inflate.decompress(data))
            size += len(parts[-1])
    except zlib.error:
        return None
    if size != want:
        return None
    return fields, b"".join(parts)[:-4], place - len(inflate.unused_data)


def records_in(source: Source, first: int, last: int):
    """(fields, body) of the records that start in ``[first, last)``.

    Inside a file the first record is searched for.  A record that lies inside the data of
    another one is not taken for it, as no member follows its end; only data that hold two
    members in a row, uncompressed, could mislead a range that begins within them.  Where a
    record must start, at the file's begin and after each record, anything else is an error.
    """
    at, sure = first, first == 0
    while at < last:
        if not sure:
            data = source.block(at, min(BLOCK, last - at) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                continue
            at += found
            if at >= last:
                return
        got = record_at(source, at)
        if got is None and sure:
            raise ValueError(f"no record starts at byte {at}")
        if got is None or not (sure or got[2] >= source.size or head_at(source, got[2])):
            at, sure = at + 1, False
            continue
        yield got[0], got[1]
        at, sure = got[2], True


def _reader(batches):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(SCHEMA.split(", "), kinds)])
    rows = []

    def table():
        made = pa.RecordBatch.from_pylist(rows, schema=schema)
        rows.clear()
        return made

    for batch in batches:
        for work in batch.to_pylist():
            source = Source(work["uri"])
            for fields, body in records_in(source, work["first"], work["last"]):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = body.partition(b"\r\n\r\n")
                size = next(
                    int(line.split(b":")[1]) for line in http.split(b"\r\n")
                    if line.lower().startswith(b"content-length:")
                )
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (made, len(payload)) != (digest, size):
                        raise ValueError(f"{work['uri']}: a payload differs from its digest")
                url = fields.get("warc-target-uri")
                rows.append({
                    "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
                    "payload_bytes": size, "payload_digest": digest, "record_type": kind,
                    "refers_to": int(fields["x-refers-to-page-id"]) if "x-refers-to-page-id" in fields else None,
                    "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                })
                if len(rows) >= 4096:
                    yield table()
    yield table()


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the files of a manifest (``uri``, ``bytes``), read by byte ranges."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    work = manifest.where("bytes > 0").select("uri", "bytes", first.alias("first"))
    work = work.select("uri", "first", F.least("bytes", F.col("first") + range_bytes).alias("last"))
    return spread(work, "uri", "first").mapInArrow(_reader, SCHEMA)


def archive_pages(pages: DataFrame, scratch: Scratch | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` as archives and read them back, a row per record.

    Null ``html`` is an empty payload, a null ``url`` an absent header.  A null ``page_id``
    is below all others and is read back as null.  Of rows that repeat the largest
    ``page_id`` of a payload the first by ``url`` is the response and the others revisit it.
    An empty table gives no file and no row; further columns are ignored.  It is an error if
    not as many records are read as the manifest says were written.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    manifest = write_archives(pages, scratch)
    records = scratch.write(read_archives(manifest, range_bytes), "records")
    wrote, read = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if wrote != read:
        raise RuntimeError(f"{wrote} records were written and {read} read")
    return records
