"""WARC archives, compressed with Zstandard and a dictionary.

An archive starts with a skippable frame that holds the dictionary, itself compressed
or not; then each record is one frame, decoded by itself with that dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.store import Replacing, Workspace, opened

DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
_FRAME = b"\x28\xb5\x2f\xfd"
_SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
#: An archive's dictionary is fitted on its first records: at most so many, of so many bytes together.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 20, 1 << 14
#: A task starts a new archive beyond so many compressed bytes.
ARCHIVE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("7f0c1f5e-3d4b-5b8e-9a51-2f6f7c0f7a10")


class BadArchive(ValueError):
    """An archive that breaks the format; says where."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    names: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.names = {k.lower(): v for k, v in self.headers.items()}

    def __getitem__(self, name: str) -> str | None:
        return self.names.get(name.lower())

    def parts(self) -> tuple[bytes | None, bytes]:
        """The HTTP head, if the block is an HTTP message, and the payload."""
        if not self.http():
            return None, self.block
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark and self["WARC-Type"] != "revisit":
            raise BadArchive(f"record at {self.offset}: no end of the HTTP headers")
        return head, payload

    def http(self) -> bool:
        """By its Content-Type; without one, by how the block starts."""
        if self["WARC-Type"] not in ("response", "request", "revisit"):
            return False
        kind = self["Content-Type"]
        return kind.partition(";")[0].strip().lower() == "application/http" if kind else self.block.startswith(b"HTTP/")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value: control characters and spaces are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


class ArchiveWriter:
    """Writes records as frames; the first of them wait until the dictionary is fitted."""

    def __init__(self, uri: str, level: int = 3, dictionary_bytes: int = DICTIONARY_BYTES):
        self.out, self.level, self.dictionary_bytes = Replacing(uri), level, dictionary_bytes
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = 0
        self.compressor = None

    def _start(self) -> None:
        samples = self.waiting
        try:
            found = zstandard.train_dictionary(self.dictionary_bytes, samples, level=self.level)
        except zstandard.ZstdError:  # too few or too small to fit one: their start serves as it is
            found = zstandard.ZstdCompressionDict(b"".join(samples)[: self.dictionary_bytes] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = found.as_bytes()
        data = min(data, zstandard.ZstdCompressor(19).compress(data), key=len)
        self._write(DICTIONARY_FRAME + len(data).to_bytes(4, "little") + data)
        self.compressor = zstandard.ZstdCompressor(self.level, dict_data=found, write_checksum=True)
        self.waiting = []
        for record in samples:
            self._write(self.compressor.compress(record))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        if self.compressor:
            self._write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.out.commit()


def records(stream, chunk: int = 1 << 20, faults: bool = False):
    """Each record of an archive, in order.  ``stream`` has read().  Raises BadArchive at the first fault, or gives it with ``faults``.

    After a fault within a record the next one follows; a broken frame ends the archive.

    Looks at: frames and their checksums, the version line, header syntax, that type, id,
    date and length are there, that the length is the block's, the closing line ends,
    and sha1 digests of block and payload.
    """
    try:
        for frame, here in _frames(stream, chunk):
            try:
                yield parse(frame, here)
            except BadArchive as e:
                if not faults:
                    raise
                yield e
    except BadArchive as e:
        if not faults:
            raise
        yield e


#: Compressed bytes that are given to the decoder at once; what lies behind a frame's end is copied.
_STEP = 1 << 13


def _frames(stream, chunk: int):
    """The contents of each frame, decoded with the dictionary, and where it starts."""
    data, at, base = stream.read(chunk), 0, 0

    def need(n: int) -> bool:
        nonlocal data, at, base
        while len(data) - at < n:
            more = stream.read(chunk)
            if not more:
                return False
            base, data, at = base + at, data[at:] + more, 0
        return True

    dictionary = None
    first = True
    while need(1):
        here = base + at
        if not need(8):
            raise BadArchive(f"torn frame at {here}")
        if _SKIPPABLE.match(data, at):
            size, kind = int.from_bytes(data[at + 4 : at + 8], "little"), data[at : at + 4]
            if not need(8 + size):
                raise BadArchive(f"torn skippable frame at {here}")
            body = data[at + 8 : at + 8 + size]
            at += 8 + size
            if kind == DICTIONARY_FRAME:
                if not first:
                    raise BadArchive(f"dictionary at {here}, not at the start")
                try:
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == _FRAME else body)
                except zstandard.ZstdError as e:
                    raise BadArchive(f"dictionary: {e}") from e
            first = False
            continue
        first = False
        if data[at : at + 4] != _FRAME:
            raise BadArchive(f"no frame at {here}")
        frame, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        try:
            while not frame.eof:
                if not need(1):
                    raise BadArchive(f"torn frame at {here}")
                piece = data[at : at + _STEP]
                parts.append(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data or b"")
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame at {here}: {e}") from e
        yield b"".join(parts), here


def parse(data: bytes, offset: int = 0) -> Record:
    """The one record that a frame holds."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive(f"record at {offset}: no WARC version or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise BadArchive(f"record at {offset}: header {line[:60]!r}")
        headers[name] = value.strip()
    record = Record(headers, b"", offset)
    if lacking := [n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length") if not record[n]]:
        raise BadArchive(f"record at {offset} lacks {', '.join(lacking)}")
    if not re.fullmatch(r"\d+", record["Content-Length"]) or int(record["Content-Length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"record at {offset}: its length is not the Content-Length {record['Content-Length']}")
    record.block = rest[:-4]
    given = record["WARC-Block-Digest"]
    if given and given.startswith("sha1:") and given[5:] != digest(record.block):
        raise BadArchive(f"record at {offset}: wrong block digest")
    given = record["WARC-Payload-Digest"]
    if record["WARC-Type"] == "response" and given and given.startswith("sha1:") and given[5:] != digest(record.parts()[1]):
        raise BadArchive(f"record at {offset}: wrong payload digest")
    return record


def _record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(key))}>"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write a record for each page; gives the archives' URIs, one or more for each task.

    Of pages with equal payloads of ``min_revisit_bytes`` or more, the one with the
    smallest id is a response and the others revisit it; all other pages are responses.
    A null payload is an empty one, a null URL is written as ``urn:x-unknown``.  A null
    id counts after all others.  Rows that repeat the id of the response of their
    payload are responses too.  Other columns are ignored; an empty table gives no archive.

    Equal payloads are found by SHA-1 from narrow rows.  Those found twice are written
    out as a table, so that Spark broadcasts it by its known size or else joins by a
    shuffle in which hot payloads are split.
    """
    space = Workspace(pages.sparkSession, "warc", folder)
    uri = space.uri
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    often = source.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size"))
    often = space.table(often.filter((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)).select(F.col("sha1").alias("again"), "first"), "often")
    ready = source.join(often, source["sha1"] == often["again"], "left").select("id", "url", "payload", F.when(F.col("id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))

    def write(batches):
        task, number, archive, name, done = TaskContext.get().partitionId(), 0, None, "", []
        try:
            for count, (i, url, payload, refers) in enumerate(row for batch in batches for row in vocab.rows(batch, "id", "url", "payload", "refers_to")):
                if archive is None:
                    name = f"{uri}/pages-{task:07d}-{number:05d}.warc.zst"
                    archive, number = ArchiveWriter(name), number + 1
                    archive.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(f"info {task} {number}")), ("WARC-Date", date), ("WARC-Filename", name.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                shared = [("WARC-Date", date), ("WARC-Target-URI", _clean(url) if url else "urn:x-unknown"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "null" if i is None else str(i))]
                if refers is None:
                    archive.add(_record([("WARC-Type", "response"), ("WARC-Record-ID", _record_id(f"page {i}")), *shared], head + payload))
                else:
                    archive.add(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(f"page {i} {task} {count}")), ("WARC-Refers-To", _record_id(f"page {refers}")), ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(refers)), *shared], head))
                if archive.size >= archive_bytes:
                    archive.close()
                    archive = None
                    done.append(name)
            if archive is not None:
                archive.close()
                archive = None
                done.append(name)
        finally:
            if archive is not None:
                archive.out.abort()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})

    # a name for each archive, as bounded as the files themselves
    return sorted(r["archive"] for r in ready.mapInArrow(write, "archive string").collect())


READ = "archive string, offset long, record_id string, record_type string, date string, url string, headers map<string,string>, http_head binary, payload binary, payload_bytes long, payload_digest string"


def read_archives(spark, archives: list[str], *, with_payload: bool = True, faults: bool = False) -> DataFrame:
    """One row per record: archive, offset, record_id, record_type, date, url, headers, http_head, payload, payload_bytes, payload_digest.

    Of HTTP messages, by their Content-Type, the head and payload are apart; other records,
    such as ``dns:`` responses, have their block as payload.  Revisits have no payload;
    their payload_bytes and payload_digest are those of the full payload, from their
    headers.  Without ``with_payload`` the payload is checked and left out.  No archives
    give no rows.  A fault in one raises BadArchive; with ``faults`` it is a row instead,
    with its message in a column ``fault`` that is null otherwise and all but ``archive``
    null.  Then the next record follows, if the frame was whole.  A task reads an archive
    at a time, a record at a time.
    """
    names = spark.createDataFrame(list(enumerate(archives)), "n int, archive string").repartitionById(max(1, len(archives)), F.col("n"))
    schema = pa.schema([(f, pa.string()) for f in ("archive",)] + [("offset", pa.int64())] + [(f, pa.string()) for f in ("record_id", "record_type", "date", "url")] + [("headers", pa.map_(pa.string(), pa.string())), ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("fault", pa.string())] * faults)

    def row(archive: str, r: Record | BadArchive):
        if isinstance(r, BadArchive):
            return archive, *[None] * 10, str(r)
        try:
            head, payload = r.parts()
        except BadArchive as e:
            if not faults:
                raise
            return archive, *[None] * 10, str(e)
        kind, size, payload_digest = r["WARC-Type"], len(payload), digest(payload)
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head or b"")
            size, payload, payload_digest = int(found[1]) if found else None, None, (r["WARC-Payload-Digest"] or "").removeprefix("sha1:") or None
        return archive, r.offset, r["WARC-Record-ID"], kind, r["WARC-Date"], r["WARC-Target-URI"], list(r.headers.items()), head, payload if with_payload else None, size, payload_digest, *[None] * faults

    def read(batches):
        for batch in batches:
            for archive in batch.column(batch.schema.get_field_index("archive")).to_pylist():
                filesystem, path = opened(archive)
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for block in vocab.chunks((row(archive, r) for r in records(stream, faults=faults)), 256):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in block], t) for i, t in enumerate(schema.types)], schema=schema)

    return names.select("archive").mapInArrow(read, READ + ", fault string" * faults)
