"""Writers: JSON lines, CSV, subtitles, documents of one object, and bundles."""

from __future__ import annotations

import json
import os
import zipfile
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.functions.times import srt

#: Stages that have a folder for their results.
STAGES = ("asr", "pii", "masked", "eval", "asr_eval", "pii_eval")


def artifact_dir(root: str, stage: str, run_id: str) -> str:
    """The folder of a stage's run, made if need be; an unknown stage raises ValueError."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    path = os.path.join(root, stage, run_id)
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def write_jsonl(frame: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON lines in a folder, nulls written out; ``append`` adds files."""
    frame.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_table(frame: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """The native twin of ``write_jsonl``: Parquet, of which scans read only what they need."""
    frame.write.mode(mode).parquet(path)


def write_csv(frame: DataFrame, path: str, *, order: list[str] | None = None) -> None:
    """CSV with a header; with ``order``, sorted in one file, for summary tables."""
    out = frame.coalesce(1).sortWithinPartitions(*order) if order else frame
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(path: str, value: dict[str, Any]) -> None:
    """One object as indented JSON in a file of the driver's."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
    os.replace(part, path)


def summary_row(frame: DataFrame) -> dict[str, Any]:
    """A frame of one row as a dictionary."""
    rows = frame.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a summary has one row, not {len(rows)}")
    return rows[0].asDict(recursive=True)


def run_meta(stage: str, run_id: str, **more: Any) -> dict[str, Any]:
    return {"stage": stage, "run_id": run_id, "created_at": datetime.now(UTC).isoformat(), **more}


def subtitles(segments: DataFrame, by: str, *, start: str = "start_sec", end: str = "end_sec", text: str = "text") -> DataFrame:
    """by, srt: the subtitles of each recording, in the order of time."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(start).alias("start_sec"), F.col(end).alias("end_sec"), F.col(text).alias("text"))))
    return segments.groupBy(by).agg(srt(rows).alias("srt"))


def bundle(path: str, files: list[str], *, root: str) -> dict[str, Any]:
    """A zip archive of files that are there, with a manifest of what is in and what is missing."""
    there, missing = [f for f in files if os.path.isfile(f)], [f for f in files if not os.path.isfile(f)]
    about = {"created_at": datetime.now(UTC).isoformat(), "files": [os.path.relpath(f, root) for f in there], "missing": [os.path.relpath(f, root) for f in missing]}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in there:
            z.write(f, os.path.relpath(f, root))
        z.writestr("manifest.json", json.dumps(about, ensure_ascii=False, indent=2))
    return about


def write_heartbeat(spark: SparkSession, path: str, *, done: int, total: int, audio_sec: float, elapsed_sec: float) -> dict[str, Any]:
    """Progress of a run with an estimate of what is left; goes to ``path`` as one object."""
    rate = audio_sec / elapsed_sec if elapsed_sec > 0 else None
    left = (total - done) * elapsed_sec / done if done else None
    state = {"files_done": done, "files_total": total, "processed_audio_sec": audio_sec, "elapsed_sec": elapsed_sec, "audio_sec_per_wall_sec": rate, "eta_sec": left, "updated_at": datetime.now(UTC).isoformat(), "application": spark.sparkContext.applicationId}
    write_json(path, state)
    return state
