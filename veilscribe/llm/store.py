"""Tables and raw files in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a local
session may go without it; then a temporary folder is made for it.
"""

from __future__ import annotations

import atexit
import ctypes
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from veilscribe.shared import checkpoint_folder


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, on any machine."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _remove(uri: str) -> None:
    filesystem, path = opened(uri)
    if filesystem.get_file_info(path).type == pafs.FileType.Directory:
        filesystem.delete_dir(path)


def there(uri: str) -> bool:
    filesystem, path = opened(uri)
    return filesystem.get_file_info(path).type == pafs.FileType.File


def put(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that a repeated or a lost task leaves no torn file."""
    filesystem, path = opened(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part, compression=None) as out:
        out.write(data)
    filesystem.move(part, path)


def free(taken, *wanted: str) -> list[str]:
    """The wanted column names, with underscores after those that are taken; case does not tell names apart."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def groups(batches, key: str):
    """Runs of rows with one key, of batches that are sorted by it: the key, and the rows as a table."""
    held, now = [], None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(now), pa.Table.from_batches(held)


def tidy(run):
    """A function of Arrow batches that gives free memory back to the machine when it ends.

    Python workers outlive their tasks and the stages of a pipeline; without this each
    keeps the most that any of its tasks had.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


class Replacing:
    """An output stream that takes its final name when it is closed in good order."""

    def __init__(self, uri: str):
        self.filesystem, self.path = opened(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.filesystem.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> None:
        self.out.close()
        self.filesystem.move(self.part, self.path)

    def abort(self) -> None:
        self.out.close()
        self.filesystem.delete_file(self.part)


def get(uri: str) -> bytes:
    filesystem, path = opened(uri)
    with filesystem.open_input_stream(path, compression=None) as stream:
        return stream.read()


class Workspace:
    """A folder of one run of an operator: named Parquet tables, and raw files beside them.

    A table is written once and read back, which cuts the lineage and survives lost
    executors.  The folder goes when the driver ends; ``drop`` frees a table earlier.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.uri = f"{(folder or checkpoint_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        filesystem, path = opened(self.uri)
        filesystem.create_dir(path, recursive=True)
        if folder is None:
            atexit.register(_remove, self.uri)

    def path(self, name: str) -> str:
        return posixpath.join(self.uri, name)

    def folder(self, name: str) -> str:
        filesystem, path = opened(self.path(name))
        filesystem.create_dir(path, recursive=True)
        return self.path(name)

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.path(name))
