"""Preparation of annotated data: columns, sub-word labels, folds, and models by preference."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from veilscribe.functions.labels import subword_labels
from veilscribe.operators.selection import folds
from veilscribe.schemas import ENTITY

# ---- fixed values: the labels, in the order of their ids, and the names of columns
KINDS = ("NAME", "PHONE", "EMAIL", "ADDRESS", "ID")
LABELS = ("O", *(f"{prefix}-{kind}" for kind in KINDS for prefix in ("B", "I")))
LABEL_IDS = {label: i for i, label in enumerate(LABELS)}
AUDIO_NAMES = ("audio", "speech", "wav")
TEXT_NAMES = ("text", "transcript", "sentence", "utterance", "normalized_text", "content")

T = TypeVar("T")
#: ids and offsets (start, end) of a text's tokens; special tokens are at (0, 0).
Tokenizer = Callable[[str], list[tuple[int, int, int]]]


def audio_column(schema: StructType) -> str:
    """The column of audio: the first of binary or of struct with bytes or samples, else by name; ValueError if there is none."""
    for f in schema.fields:
        if isinstance(f.dataType, BinaryType) or (isinstance(f.dataType, StructType) and {"bytes", "array"} & set(f.dataType.names)):
            return f.name
    named = [n for n in AUDIO_NAMES if n in schema.names]
    if not named:
        raise ValueError("no audio column")
    return named[0]


def text_column(columns: Sequence[str]) -> str:
    """The column of transcripts: by its name, else the first whose name speaks of text; ValueError if there is none."""
    likely = [n for n in TEXT_NAMES if n in columns] or [c for c in columns if "text" in c.lower() or "transcript" in c.lower()]
    if not likely:
        raise ValueError(f"no transcript column in {list(columns)}")
    return likely[0]


def first_working(*makers: Callable[[], T]) -> Callable[[], T]:
    """A maker that tries others in turn; what the last one raises goes on."""

    def make() -> T:
        for maker in makers[:-1]:
            try:
                return maker()
            except Exception:  # noqa: BLE001, S112  a model may fail to load in any way
                continue
        return makers[-1]()

    return make


def device_index(setting: object, available: int = 0) -> int:
    """-1 for the CPU, else the number of a device: ``cpu``, a number, ``cuda`` or ``cuda:n``; without devices, and for anything else, the CPU."""
    if isinstance(setting, int) and not isinstance(setting, bool):
        return setting
    name = str(setting or "cpu").strip().lower()
    if name.isdigit():
        return int(name)
    number = name.removeprefix("cuda").removeprefix(":")
    if not name.startswith("cuda") or not available:
        return -1
    return int(number) if number.isdigit() else 0


def word_tokenizer() -> Tokenizer:
    """A deterministic stand-in for a sub-word tokenizer: pieces of at most four letters, with special tokens at both ends."""
    piece = re.compile(r"\w{1,4}|[^\w\s]")
    return lambda text: [(0, 0, 0), *((1 + zlib.crc32(m[0].encode()) % 32_000, *m.span()) for m in piece.finditer(text)), (2, 0, 0)]


def _tokens(make: Callable[[], Tokenizer], text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for texts in batches:
            yield pd.Series([[{"id": i, "start": a, "end": b} for i, a, b in tokenizer(t or "")] for t in texts])

    return F.pandas_udf(run, "array<struct<id: int, start: int, end: int>>")(text)


def subword_records(gold: DataFrame, make: Callable[[], Tokenizer] = word_tokenizer, label_ids: dict[str, int] | None = None) -> DataFrame:
    """record_id, language, text, input_ids, attention_mask, labels of gold records; a tokenizer is made once per Python task."""
    nothing = F.expr(f"cast(array() as array<{ENTITY}>)")
    rows = gold.select("record_id", "language", F.coalesce("transcript", F.lit("")).alias("text"), F.coalesce("entities", nothing).alias("entities")).withColumn("tokens", _tokens(make, F.col("text")))
    return rows.select(
        "record_id", "language", "text", F.transform("tokens", lambda t: t["id"]).alias("input_ids"), F.transform("tokens", lambda t: F.lit(1)).alias("attention_mask"),
        subword_labels(F.col("tokens"), F.col("entities"), label_ids or LABEL_IDS).alias("labels"),
    )


def subword_folds(records: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Sub-word records with the fold each is held out in."""
    return folds(records, k, key="record_id", seed=seed)
