"""Audio: decoding to mono at 16 kHz, headers, and members of split archives."""

from __future__ import annotations

import io
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilscribe.operators.masking import read_wave, write_wave
from veilscribe.sources.files import textgrid_text

RATE = 16_000


def to_mono(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """The mean of the channels, resampled by linear interpolation, as float32."""
    x = np.asarray(samples, np.float32)
    x = x.mean(axis=1) if x.ndim > 1 else x
    if rate == to or not len(x):
        return x.astype(np.float32)
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] at 16 kHz of a WAV file."""
    raw, params = read_wave(data)
    scaled = (raw.astype(np.float32) - 128) / 128 if params.sampwidth == 1 else raw.astype(np.float32) / float(1 << (8 * params.sampwidth - 1))
    return to_mono(scaled, params.framerate), RATE


def header(data: bytes) -> tuple[float, int]:
    """Seconds and sampling rate, from the header."""
    with wave.open(io.BytesIO(data)) as f:
        return (f.getnframes() / f.getframerate() if f.getframerate() else 0.0), f.getframerate()


def read_headers(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path, duration_sec, sampling_rate; nulls for files that are no WAV.  A task reads a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, *header(content)))
                except (wave.Error, EOFError):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "duration_sec", "sampling_rate"]).astype({"sampling_rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, duration_sec double, sampling_rate int")


def normalised(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """path, content: files as mono WAV of 16 bits at 16 kHz."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                samples, rate = decode(content)
                pcm = np.clip(np.rint(samples * 32767), -32768, 32767).astype("<i2")[:, None]
                out.append(write_wave(pcm, wave._wave_params(1, 2, rate, len(pcm), "NONE", "")))
            yield pd.DataFrame({"path": batch["path"], "content": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, content binary")


# ------------------------------------------------------------------------- split archives


class _Parts(io.RawIOBase):
    """Files one after another as one stream."""

    def __init__(self, paths: list[str]):
        self.paths, self.now = list(paths), None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.now is None:
                if not self.paths:
                    return 0
                self.now = open(self.paths.pop(0), "rb")  # noqa: SIM115
            n = self.now.readinto(buffer)
            if n:
                return n
            self.now.close()
            self.now = None


class SplitArchive(DataSource):
    """``spark.read.format("split_tar_gz")``: members of a gzipped tar that is split into parts.

    Options: ``path``, the parts in order, with semicolons between archives' groups of
    parts joined by commas; ``members``, comma-separated names, or none for all.  A stream
    can only be read from its start, so that an archive is one task; it ends once all its
    wanted members are found.
    """

    @classmethod
    def name(cls) -> str:
        return "split_tar_gz"

    def schema(self) -> str:
        return "archive int, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.archives = [a.split(",") for a in options["path"].split(";") if a]
        self.members = frozenset(m for m in options.get("members", "").split(",") if m)

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.archives))]

    def read(self, partition):
        left = set(self.members)
        with tarfile.open(fileobj=io.BufferedReader(_Parts(self.archives[partition.value])), mode="r|gz") as tar:
            for member in tar:
                name = member.name.removeprefix("./").lstrip("/")
                if not member.isfile() or (self.members and name not in left):
                    continue
                left.discard(name)
                yield partition.value, name, tar.extractfile(member).read()
                if self.members and not left:
                    return


def read_archives(spark: SparkSession, archives: list[list[str]], members: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(SplitArchive)
    return spark.read.format("split_tar_gz").option("path", ";".join(",".join(parts) for parts in archives)).option("members", ",".join(members or [])).load()


def with_members(index: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of an index with their audio (rows without it are left out) and the text of their tiers (null if missing)."""
    wav = members.select(F.col("name").alias("wav_rel"), F.col("content").alias("wav"))
    grid = members.select(F.col("name").alias("textgrid_rel"), textgrid_text(F.col("content").cast("string")).alias("transcript"))
    return index.join(wav, "wav_rel").join(grid, "textgrid_rel", "left")
