import base64
import hashlib
import io
import re

import pytest
import zstandard

from veilscribe.llm import queries, warc


def test_op5_is_brute_force(spark, data):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    expected = sorted(str((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p])) for i, p in pages)
    assert sorted(str(tuple(r)) for r in queries.op5_warc(spark, data).collect()) == expected


ROWS = [(1, "http://a/ b\r\nX: y", "one"), (2, None, "one"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "one"), (5, "http://f", "é" * 300_000), (1, "http://a", "one"), (6, "http://g", "two\r\n\r\nthree")]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(*r, 0, "x") for r in ROWS], "page_id long, url string, html string, offset int, Archive string")
    archives = warc.write_archives(pages, archive_bytes=100)
    rows = [r for r in warc.read_archives(spark, archives).collect() if r["record_type"] != "warcinfo"]
    kinds = sorted((str(r["headers"]["X-Page-Id"]), r["record_type"], r["headers"].get("X-Refers-To-Page-Id"), r["payload_bytes"]) for r in rows)
    assert kinds == sorted([("1", "response", None, 3), ("1", "response", None, 3), ("2", "revisit", "1", 3), ("3", "response", None, 0), ("4", "revisit", "3", 0), ("null", "revisit", "1", 3), ("5", "response", None, 600_000), ("6", "response", None, 12)])
    assert bytes(next(r["payload"] for r in rows if r["headers"]["X-Page-Id"] == "6")) == b"two\r\n\r\nthree"
    assert next(r["url"] for r in rows if "a/" in r["url"]) == "http://a/%20b%0D%0AX:%20y"
    small = [r["record_type"] for r in warc.read_archives(spark, warc.write_archives(pages, min_revisit_bytes=1)).collect() if r["headers"].get("X-Page-Id") in ("3", "4")]
    assert small == ["response"] * 2
    assert warc.write_archives(pages.limit(0)) == [] and warc.read_archives(spark, []).collect() == []


def archive(tmp_path, n=20):
    writer = warc.ArchiveWriter(str(tmp_path / "a.warc.zst"))
    for k in range(n):
        body = b"HTTP/1.1 200 OK\r\n\r\n" + f"page {k} ".encode() * 50
        writer.add(warc._record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z")], body))
    writer.close()
    return (tmp_path / "a.warc.zst").read_bytes()


def test_frames_stand_alone_with_the_dictionary(tmp_path):
    data = archive(tmp_path)
    assert data[:4] == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    raw = data[8 : 8 + size]
    raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + size
    records = list(warc.records(io.BytesIO(data), chunk=7))
    assert len(records) == 20
    for r in records:
        assert r.offset == at or r.offset > at
        piece = tool.decompressobj().decompress(data[r.offset :])
        assert piece.startswith(b"WARC/1.1\r\n") and re.search(rb"page \d+ ", piece)
        at = r.offset


@pytest.mark.parametrize(("spoil", "message"), [(lambda d: d[:-3], "torn"), (lambda d: d[:-60] + bytes([d[-60] ^ 255]) + d[-59:], "."), (lambda d: d + b"junkjunk", "no frame"), (lambda d: d + d, "dictionary"), (lambda d: d[:6], "torn")])
def test_faults_are_told(tmp_path, spoil, message):
    with pytest.raises(warc.BadArchive, match=message):
        list(warc.records(io.BytesIO(spoil(archive(tmp_path)))))


@pytest.mark.parametrize(("old", "new", "message"), [(b"WARC/1.1", b"WARC/9.1", "version"), (b"Content-Length: 8", b"Content-Length: 9", "Content-Length"), (b"WARC-Date", b"X-Date", "lacks"), (b"body", b"bodx", "digest"), (b"WARC-Type:", b"WARC Type:", "header")])
def test_records_are_checked(old, new, message):
    record = warc._record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")], b"the body")
    assert warc.parse(record).block == b"the body" and old in record
    with pytest.raises(warc.BadArchive, match=message):
        warc.parse(record.replace(old, new))


DATE = ("WARC-Date", "2024-01-01T00:00:00Z")


def real(tmp_path):
    """What crawls hold besides pages: DNS answers, requests, metadata, records without a type of content, and faults."""
    writer = warc.ArchiveWriter(str(tmp_path / "r.warc.zst"))
    add = lambda kind, k, block, *more: writer.add(warc._record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{k}>"), DATE, *more], block))
    add("response", 1, b"20240101000000\nexample.org.\t300\tIN\tA\t192.0.2.1\n", ("Content-Type", "text/dns"), ("WARC-Target-URI", "dns:example.org"), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'20240101000000' + chr(10).encode() + b'example.org.' + chr(9).encode() + b'300' + chr(9).encode() + b'IN' + chr(9).encode() + b'A' + chr(9).encode() + b'192.0.2.1' + chr(10).encode())}"))
    add("request", 2, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", ("Content-Type", "Application/HTTP; msgtype=request"))
    add("response", 3, b"HTTP/1.1 200 OK\r\n\r\nbody")
    add("response", 4, b"no head at all", ("Content-Type", "application/http"))
    add("metadata", 5, b"a: b\r\n\r\n", ("Content-Type", "application/warc-fields"))
    add("revisit", 6, b"", ("Content-Type", "application/http; msgtype=response"))
    add("response", 7, b"HTTP/1.1 200 OK\r\n\r\nx", ("Content-Type", "application/http"), ("WARC-Payload-Digest", "sha1:AAAA"))
    add("resource", 8, b"\x00\x01", ("Content-Type", "image/png"))
    writer.close()
    return str(tmp_path / "r.warc.zst")


def test_records_of_real_crawls(spark, tmp_path):
    name = real(tmp_path)
    with pytest.raises(Exception, match="no end of the HTTP headers|payload digest"):
        warc.read_archives(spark, [name]).collect()
    rows = warc.read_archives(spark, [name], faults=True).collect()
    good = {r["record_id"]: r for r in rows if r["fault"] is None}
    assert sorted(good) == [f"<urn:{k}>" for k in (1, 2, 3, 5, 6, 8)]
    assert good["<urn:1>"]["http_head"] is None and bytes(good["<urn:1>"]["payload"]).startswith(b"2024") and good["<urn:1>"]["url"] == "dns:example.org"
    assert bytes(good["<urn:3>"]["payload"]) == b"body" and bytes(good["<urn:2>"]["http_head"]).startswith(b"GET /") and good["<urn:6>"]["payload"] is None
    assert bytes(good["<urn:5>"]["payload"]) == b"a: b\r\n\r\n" and good["<urn:8>"]["payload_bytes"] == 2
    faults = [r["fault"] for r in rows if r["fault"]]
    assert len(faults) == 2 and any("no end" in f for f in faults) and any("digest" in f for f in faults)


def test_a_torn_archive_is_a_row_of_its_own(spark, tmp_path):
    whole = archive(tmp_path)
    (tmp_path / "torn.warc.zst").write_bytes(whole[:-20])
    rows = warc.read_archives(spark, [str(tmp_path / "torn.warc.zst"), str(tmp_path / "a.warc.zst")], faults=True).collect()
    assert sum(r["fault"] is None for r in rows) == 39 and [r["archive"] for r in rows if r["fault"]] == [str(tmp_path / "torn.warc.zst")]


def test_a_long_record_between_short_ones(tmp_path):
    import os

    writer = warc.ArchiveWriter(str(tmp_path / "l.warc.zst"))
    blocks = [b"short", os.urandom(3_000_000), b"", b"last" * 10]
    for k, block in enumerate(blocks):
        writer.add(warc._record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:{k}>"), DATE], block))
    writer.close()
    assert [r.block for r in warc.records(io.BytesIO((tmp_path / "l.warc.zst").read_bytes()))] == blocks


def test_a_failed_writer_leaves_no_part_files(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(k, "u", "x" * k) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    broken = pages.withColumn("html", F.when(F.col("page_id") == 40, F.raise_error(F.lit("broken"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="broken"):
        warc.write_archives(broken, folder=str(tmp_path))
    assert not [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".part")]
