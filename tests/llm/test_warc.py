import base64
import gzip
import hashlib
import zlib

import pytest

from tessera.llm import warc
from tessera.scratch import Scratch

SCHEMA = "page_id long, url string, html string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    largest, out, used = {}, [], set()
    for i, _, html in rows:
        payload = (html or "").encode()
        known = largest.get(payload)
        largest[payload] = i if known is None else known if i is None else max(known, i)
    for i, _, html in sorted(rows, key=str):
        payload = (html or "").encode()
        first = i == largest[payload] and payload not in used
        if first:
            used.add(payload)
        out.append((i, len(payload), digest(payload), "response" if first else "revisit", None if first else largest[payload]))
    return sorted(out, key=str)


def pages_of(prose):
    shared = "<p>" + prose(1, 300) + "</p>"
    rows = [(k, f"http://h/{k}", shared) for k in range(20)]
    rows += [(k, f"http://h/{k}?q=%0A", f"<p>{prose(k, 50)}") for k in range(20, 60)]
    rows += [(60, None, None), (61, "u\r\nX-Evil: 1", ""), (None, "n", shared), (None, "n", "alone")]
    return rows + [(19, "other", shared), (70, "long", "é" * 400_000), (71, "crlf", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("size", [137, 4096, 1 << 22])
def test_round_trip_by_ranges(spark, prose, size):
    from pyspark.sql import functions as F

    rows = pages_of(prose)
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("_sha1", F.lit(1)).withColumn("uri", F.lit(2))
    got = warc.archive_pages(pages, range_bytes=size).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert sorted((r.url for r in got), key=str) == sorted((r[1] for r in rows), key=str)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 50), (4, "d", "y" * 50)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), Scratch(spark), least_bytes=10)
    got = {r.page_id: r.record_type for r in warc.read_archives(manifest).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_files_are_gzip_members_of_warc(spark):
    rows = [(1, "http://a", "<p>é"), (2, "http://b", "<p>é")]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), Scratch(spark))
    text = b"".join(gzip.decompress(open(r.uri.removeprefix("file:"), "rb").read()) for r in manifest.collect())
    assert text.count(b"WARC/1.1\r\n") == text.count(b"WARC-Type: warcinfo") + 2
    assert b"WARC-Type: revisit" in text and b"WARC-Refers-To: <urn:uuid:" in text
    assert text.count("<p>é".encode()) == 1


def test_false_starts(tmp_path):
    """Magic inside data, and whole records stored inside another one, are not records."""
    inner = warc.record(5, "inner", b"inner", digest(b"inner"), 1, True, 5)
    body = b"\x1f\x8b\x08" * 50 + inner + b"\x1f\x8b\x08tail"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(head + body + b"\r\n\r\n") + packer.flush()
    last = warc.record(6, "last", b"last", digest(b"last"), 1, True, 6)
    file = tmp_path / "a.warc.gz"
    file.write_bytes(outer + last)
    source = warc.Source(f"file:{file}")
    for cut in (0, 1, 10, len(outer) - 1, len(outer), len(outer) + 1):
        first = [f.get("x-page-id") for f, _ in warc.records_in(source, 0, cut)]
        rest = [f.get("x-page-id") for f, _ in warc.records_in(source, cut, source.size)]
        assert first + rest == [None, "6"]
    assert len(list(warc.records_in(source, 1, len(outer)))) == 0


def test_url_longer_than_any_block(spark):
    long = "data:," + "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(20_000))
    rows = [(1, "http://a", "<p>1"), (2, long, "<p>2"), (3, "http://c", "<p>3"), (4, long + "4", None)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for size in (1 << 16, 1 << 22):
        got = warc.archive_pages(pages, range_bytes=size).collect()
        assert sorted((r.page_id, r.url) for r in got) == [r[:2] for r in rows]


def test_what_is_no_record_is_an_error(tmp_path):
    one = warc.record(1, "a", b"one", digest(b"one"), 1, True, 1)
    file = tmp_path / "a.warc.gz"
    file.write_bytes(one + b"\0" + one)
    with pytest.raises(ValueError, match=f"byte {len(one)}"):
        list(warc.records_in(warc.Source(f"file:{file}"), 0, 2 * len(one) + 1))


def test_lost_records_are_noticed(spark, monkeypatch):
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a: read(*a).where("page_id <> 2"))
    with pytest.raises(RuntimeError, match="2 records were written and 1 read"):
        warc.archive_pages(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA))
