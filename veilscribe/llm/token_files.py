"""Token-id shards and their index.

A shard holds the raw ids of documents in ascending id order, one document after
another, each closed by an end id::

    b"VSIDS01\\0" | ids, little-endian unsigned of 2 or 4 bytes | starts of the
    documents, 8 bytes each, and the end | b"VSIDS01\\0" bytes-per-id, documents, ids

The index is a minimal perfect hash over the distinct document keys, split by key hash
into files of bounded size.  Keys are told apart by 128 bits.  A key's slot holds a
stored fingerprint, the shard, the document's place in it and how many rows have the
key.  A lookup reads one index file, two starts and the ids: constant time, whatever
the number of documents.
"""

from __future__ import annotations

import io
import struct
import zlib
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.store import Replacing, Workspace, free, get, opened, put

MAGIC = b"VSIDS01\0"
_TRAILER = struct.Struct("<8sQQQ")
#: A task starts a new shard beyond so many ids.
SHARD_IDS = 1 << 26
#: Keys in an index file, about; and index files at least.
INDEX_KEYS, INDEX_FILES = 1 << 16, 128
#: Documents between two that are asked for, and ids, that are read along with them.
GAP_DOCS, READ_IDS = 8, 1 << 20


# ---------------------------------------------------------------- minimal perfect hash


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(key) -> tuple[int, int]:
    """The two 64-bit hashes of a key; Spark's xxhash64 of the marked key as a string gives the same, as signed numbers.  A null key is no string."""
    return tuple(xxhash.xxh64_intdigest(mark if key is None else mark + str(key), 42) for mark in (_NULL if key is None else _TEXT))


_TEXT, _NULL = ("a", "b"), ("c", "d")


def _together(hashes: np.ndarray, more: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of two, another for each seed."""
    return _mix(hashes ^ _mix(more, 2 * seed + 1), 2 * seed + 2)


class PerfectHash:
    """Maps n distinct 64-bit hashes to 0 .. n-1 by levels of bit fields.

    On each level every remaining hash points at one of twice as many bits; those alone
    at their bit stay, the others go down a level.  A hash's number is the rank of its
    bit.  What is left after ``LEVELS`` (equal hashes only) is not placed.
    """

    LEVELS = 48

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, fields, sizes = np.unique(hashes), [], []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = (_mix(left, level + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate([*fields, np.zeros(1, "<u8")]), np.array(sizes, np.int64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes; -1 for those that surely are not in."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = self.first[level] + (_mix(hashes[todo], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[held]] = (self.rank[word] + below)[held]
            todo = todo[~held]
        return out


class IndexFile:
    """One file of the index: a perfect hash and, by its numbers, what it says of each key."""

    FIELDS = ("fingerprint", "shard", "ordinal", "copies")

    def __init__(self, perfect: PerfectHash, seed: int, columns: dict[str, np.ndarray]):
        self.perfect, self.seed, self.columns = perfect, seed, columns

    @classmethod
    def build(cls, hashes: np.ndarray, more: np.ndarray, shard: np.ndarray, ordinal: np.ndarray, copies: np.ndarray) -> IndexFile:
        """Of keys with their two hashes.  Keys that the seed does not tell apart get another one; only equal 128 bits raise."""
        order = np.lexsort((more, hashes))
        if ((hashes[order][1:] == hashes[order][:-1]) & (more[order][1:] == more[order][:-1])).any():
            raise ValueError("two document keys have the same 128-bit hash")
        seed = next(k for k in count() if len(np.unique(_together(hashes, more, k))) == len(hashes))
        one = _together(hashes, more, seed)
        perfect = PerfectHash.build(one)
        order = np.argsort(perfect(one))
        return cls(perfect, seed, {"fingerprint": more[order], "shard": shard[order].astype(np.uint32), "ordinal": ordinal[order].astype(np.uint64), "copies": copies[order].astype(np.uint64)})

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), bits=self.perfect.bits, sizes=self.perfect.sizes, seed=self.seed, **self.columns)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> IndexFile:
        held = np.load(io.BytesIO(data))
        return cls(PerfectHash(held["bits"], held["sizes"]), int(held["seed"]), {k: held[k] for k in cls.FIELDS})

    def look_up(self, hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are in, by their fingerprints, and the columns for those."""
        at = self.perfect(_together(hashes, more, self.seed))
        inside = at >= 0
        inside[inside] = self.columns["fingerprint"][at[inside]] == more[inside]
        return inside, {k: v[at[inside]] for k, v in self.columns.items()}


# ------------------------------------------------------------------------------ shards


class ShardWriter:
    def __init__(self, uri: str, dtype: np.dtype):
        self.out, self.dtype, self.starts = Replacing(uri), dtype, [0]
        self.out.write(MAGIC)

    def add(self, packed: bytes) -> int:
        self.out.write(packed)
        self.starts.append(self.starts[-1] + len(packed) // self.dtype.itemsize)
        return self.starts[-1] - self.starts[-2]

    def close(self) -> None:
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(_TRAILER.pack(MAGIC, self.dtype.itemsize, len(self.starts) - 1, self.starts[-1]))
        self.out.commit()


class Shard:
    """Reads documents of a shard by their places in it."""

    def __init__(self, uri: str):
        filesystem, path = opened(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        if size < _TRAILER.size + 16:
            raise ValueError(f"{uri} is too short for a shard")
        magic, width, self.documents, self.n_ids = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC or width not in (2, 4) or size != 8 + width * self.n_ids + 8 * (self.documents + 1) + _TRAILER.size or self._at(0, 8) != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.dtype, self.table = np.dtype(f"<u{width}"), 8 + width * self.n_ids

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def starts(self, first: int, count: int) -> np.ndarray:
        """Starts of ``count`` documents from the ``first`` on, and the end of the last."""
        return np.frombuffer(self._at(self.table + 8 * first, 8 * (count + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._at(8 + self.dtype.itemsize * start, self.dtype.itemsize * (end - start)), self.dtype)

    def close(self) -> None:
        self.file.close()


class TokenFiles:
    """Written shards with their index.  ``shards`` are the file names in order, ``bases`` the ids before each."""

    def __init__(self, uri: str, shards: list[str], totals: list[int], index_files: int, key_type: str):
        self.uri, self.shards, self.index_files, self.key_type = uri, shards, index_files, key_type
        self.bases = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)

    def get(self, key) -> list[np.ndarray]:
        """Ids of each row with the key, in order; an empty list if there is none."""
        hashes, more = (np.array([h], np.uint64) for h in key_hashes(key))
        inside, held = _index_file(self.uri, int(hashes[0] % np.uint64(self.index_files))).look_up(hashes, more)
        if not inside[0]:
            return []
        shard = Shard(f"{self.uri}/shards/{self.shards[int(held['shard'][0])]}")
        starts = shard.starts(int(held["ordinal"][0]), int(held["copies"][0]))
        found = [shard.ids(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        shard.close()
        return found

    def read(self, keys: DataFrame, key_col: str, *, with_ids: bool = True) -> DataFrame:
        """Every row written for the distinct keys: key, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

        Keys that were never written give no row; a result named like the key has an
        underscore after it.  Two shuffles of narrow rows: to the index files, then to the
        shards, where documents that lie near each other are one read.
        """
        uri, shards, bases, files, kind = self.uri, self.shards, self.bases, self.index_files, self.key_type
        place = "key {0}, shard int, ordinal long, copies long".format(kind)

        def find(batches):
            for batch in batches:
                hashes, more = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (1, 2))
                file_of = (hashes % np.uint64(files)).astype(np.int64)
                for f in np.unique(file_of):
                    mine = np.flatnonzero(file_of == f)
                    inside, held = _index_file(uri, int(f)).look_up(hashes[mine], more[mine])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine[inside])), pa.array(held["shard"].astype(np.int32)), pa.array(held["ordinal"].astype(np.int64)), pa.array(held["copies"].astype(np.int64))], ["key", "shard", "ordinal", "copies"])

        def fetch(batches):
            number, shard = -1, None
            for batch in batches:
                of, ordinal, copies = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
                for a, b in _near_places(of, ordinal, copies):
                    if of[a] != number:
                        if shard:
                            shard.close()
                        number, shard = int(of[a]), Shard(f"{uri}/shards/{shards[of[a]]}")
                    first = int(ordinal[a])
                    starts = shard.starts(first, int(ordinal[b - 1] + copies[b - 1]) - first)
                    rows = np.repeat(np.arange(a, b), copies[a:b])
                    docs = ordinal[rows] - first + np.arange(len(rows)) - np.repeat(np.cumsum(copies[a:b]) - copies[a:b], copies[a:b])
                    begin, end = starts[docs], starts[docs + 1]
                    found = []
                    for x, y in _reads(begin, end):
                        ids = shard.ids(int(begin[x]), int(end[y - 1])).astype("<u4")
                        found += [ids[p:q].tobytes() for p, q in zip((begin[x:y] - begin[x]).tolist(), (end[x:y] - begin[x]).tolist(), strict=True)]
                    columns = [batch.column(0).take(pa.array(rows)), pa.array(bases[number] + begin), pa.array(end - begin), pa.array(list(map(zlib.crc32, found)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(found, pa.binary())] * with_ids], ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

        hashed = keys.select(F.col(key_col).alias("key")).distinct().select("key", *_spark_hashes("key"))
        sent = hashed.repartitionById(files, _bucket("hash", files)).mapInArrow(find, place)
        sent = sent.repartitionById(max(1, len(shards)), F.col("shard")).sortWithinPartitions("shard", "ordinal")
        return sent.mapInArrow(fetch, f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).toDF(key_col, *free([key_col], "start", "n_tokens", "ids_crc32", *["ids"] * with_ids))


def _near_places(shard: np.ndarray, ordinal: np.ndarray, copies: np.ndarray, rows: int = 512):
    """Runs of up to ``rows`` rows whose documents lie near each other in one shard."""
    if len(shard):
        apart = (shard[1:] != shard[:-1]) | (ordinal[1:] - ordinal[:-1] - copies[:-1] > GAP_DOCS)
        edges = np.flatnonzero(np.concatenate([[True], apart, [True]])).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield from ((k, min(b, k + rows)) for k in range(a, b, rows))


def _reads(begin: np.ndarray, end: np.ndarray):
    """Runs of documents that are one read: up to about ``READ_IDS`` ids, or one document."""
    part = (begin - begin[0]) // READ_IDS
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
    return zip(edges, edges[1:], strict=False)


@lru_cache(maxsize=8)
def _index_file(uri: str, number: int) -> IndexFile:
    return IndexFile.from_bytes(get(f"{uri}/index/{number:06d}.idx"))


def _spark_hashes(key: str) -> list:
    text = F.col(key).cast("string")
    return [F.xxhash64(F.coalesce(F.concat(F.lit(t), text), F.lit(n))).alias(name) for t, n, name in zip(_TEXT, _NULL, ("hash", "more"), strict=True)]


def _bucket(hash_col: str, files: int):
    """The unsigned remainder of a signed hash, so that Python agrees."""
    half = F.shiftrightunsigned(F.col(hash_col), 1)
    return (((half % files) * 2 + F.col(hash_col).bitwiseAND(F.lit(1))) % files).cast("int")


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = vocab.DEFAULT_VOCABULARY, end_id: int = 0, folder: str | None = None, shard_ids: int = SHARD_IDS) -> TokenFiles:
    """Encode every whole text, close it with ``end_id`` and write shards and index.

    Documents are in ascending id order over all shards, null ids first.  A null text is
    an empty one.  Rows that repeat an id stay in one shard side by side, ordered by
    their texts' hashes; a lookup gives all of them.  An empty table gives no shard.
    Other columns of ``docs`` are ignored.  ``folder`` defaults to the shared folder and
    the files in it then go when the driver ends.

    The texts are shuffled once, by ranges of the id; each task then encodes and writes.
    A repeated task writes the same names and contents again.
    """
    space = Workspace(docs.sparkSession, "token-files", folder)
    space.folder("shards")
    space.folder("index")
    uri = space.uri
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def write(batches):
        encoder, task = vocab.encoder(vocabulary), TaskContext.get().partitionId()
        end, shard, name, number = np.array([end_id], encoder.dtype).tobytes(), None, "", 0
        try:
            for batch in batches:
                names, places, lengths = [], [], []
                for (text,) in vocab.rows(batch, "text"):
                    packed = encoder.packed(text or "") + end
                    if shard is None:
                        name = f"ids-{task:07d}-{number:05d}.bin"
                        shard, number = ShardWriter(f"{uri}/shards/{name}", encoder.dtype), number + 1
                    names.append(name)
                    places.append(len(shard.starts) - 1)
                    lengths.append(shard.add(packed))
                    if shard.starts[-1] >= shard_ids:
                        shard.close()
                        shard = None
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], ["id", "name", "ordinal", "n"])
            if shard is not None:
                shard.close()
                shard = None
        finally:
            if shard is not None:
                shard.out.abort()

    ordered = source.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    places = space.table(ordered.mapInArrow(write, f"id {kind}, name string, ordinal long, n long"), "places")
    # one row for each shard, as bounded as the files themselves
    shards = sorted(map(tuple, places.groupBy("name").agg(F.sum("n")).collect()))
    numbers = docs.sparkSession.createDataFrame([(name, k) for k, (name, _) in enumerate(shards)], "name string, shard int")
    rows_written = places.count()
    files = max(INDEX_FILES, -(-rows_written // INDEX_KEYS))

    def build(batches):
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        whole = pa.concat_tables(parts)
        hashes = whole["hash"].to_numpy().astype(np.int64).view(np.uint64)
        file_of = (hashes % np.uint64(files)).astype(np.int64)
        for f in np.unique(file_of):
            at = np.flatnonzero(file_of == f)
            more = whole["more"].to_numpy().astype(np.int64).view(np.uint64)
            held = IndexFile.build(hashes[at], more[at], *(whole[c].to_numpy()[at] for c in ("shard", "ordinal", "copies")))
            put(f"{uri}/index/{int(f):06d}.idx", held.to_bytes())
            yield pa.RecordBatch.from_pydict({"file": pa.array([f], pa.int32()), "keys": pa.array([len(at)], pa.int64())})

    # rows that repeat an id are neighbours, so each key is a run; shards are listed in order
    first = F.min(F.struct("shard", "ordinal"))
    keys = places.join(numbers, "name").groupBy("id").agg(first.alias("first"), F.count("*").alias("copies"))
    keys = keys.select(*_spark_hashes("id"), F.col("first.shard").alias("shard"), F.col("first.ordinal").alias("ordinal"), "copies")
    built = {r["file"] for r in keys.repartitionById(files, _bucket("hash", files)).mapInArrow(build, "file int, keys long").collect()}
    empty = IndexFile.build(*(np.array([], t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))).to_bytes()
    for f in set(range(files)) - built:
        put(f"{uri}/index/{f:06d}.idx", empty)
    space.drop("places")
    return TokenFiles(uri, [name for name, _ in shards], [n for _, n in shards], files, kind)
