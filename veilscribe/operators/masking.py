"""From spans to masked audio: time intervals, their union, the audit of each source, and the audio itself."""

from __future__ import annotations

import io
import posixpath
import uuid
import wave
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscribe.functions import times
from veilscribe.functions.matches import no_spans

#: Seconds of a bucket in which intervals are first joined, so that a long source is not one sort.
BUCKET_SEC = 600.0
MOST_LISTED = 200


@dataclass(frozen=True)
class MaskOptions:
    """How to mask; ``of`` reads a configuration, in which 0 means the default for some settings and nothing for others."""

    mode: str = "silence"
    lead: float = 0.0
    tail: float = 0.12
    least: float = 0.20
    gap: float = 0.05
    beep_hz: int = 1000
    beep_gain_db: float = -6.0
    beep_amplitude: float = 0.20
    #: What happens to audio that cannot be masked: with ``copy`` it goes out as it is, with ``refuse`` not at all.
    on_error: str = "copy"

    @classmethod
    def of(cls, config: dict) -> MaskOptions:
        mode = str(config.get("mode", "silence")).strip().lower()
        positive = lambda name, default: max(0.0, float(config.get(name, default) or 0.0))
        both = positive("pad_sec", 0.0)
        return cls(
            mode if mode in ("silence", "beep") else "silence", positive("lead_sec", both or 0.0), positive("tail_sec", both or 0.12), positive("min_interval_sec", 0.20), positive("merge_gap_sec", 0.05),
            int(config.get("beep_freq_hz") or 1000), float(config.get("beep_gain_db") or -6.0), float(config.get("beep_amplitude") or 0.20), "refuse" if config.get("on_error") == "refuse" else "copy",
        )


# ----------------------------------------------------------------------------- intervals


def merge_intervals(rows: DataFrame, keys: list[str], *, gap: float, start: str = "start", end: str = "end", bucket_sec: float | None = BUCKET_SEC) -> DataFrame:
    """keys, start, end: intervals of each key joined where one starts at most ``gap`` after the end of those before.

    Intervals are joined within buckets of time.  A bucket then has, from the last ends and
    the last intervals of the buckets before, what goes on from there, so that a key is
    never one sort of its rows, only of its buckets.  Null ends and empty intervals are
    left out.
    """
    from_key = F.lit(True)
    for k in keys:
        from_key = from_key & F.col(k).eqNullSafe(F.col(f"__{k}"))
    other = [F.col(k).alias(f"__{k}") for k in keys]
    bucket = F.floor(F.col(start) / bucket_sec) if bucket_sec else F.lit(0).cast("long")
    out = rows.select(*keys, F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end)).filter(F.col(end) > F.col(start)).withColumn("__bucket", bucket)
    order = Window.partitionBy(*keys, "__bucket").orderBy(start, end)
    up_to, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    buckets = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)

    def beside(frame: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
        known = known.select(*other, F.col("__bucket").alias("__at"), *columns)
        return frame.join(known, from_key & (F.col("__bucket") == F.col("__at"))).select(*frame.columns, *columns)

    ends = out.groupBy(*keys, "__bucket").agg(F.max(end).alias("__end")).withColumn("__carried", F.max("__end").over(buckets))
    before = F.greatest("__carried", F.max(end).over(earlier))
    marked = beside(out, ends, "__carried").withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    counted = marked.withColumn("__n", F.sum("__new").over(up_to)).groupBy(*keys, "__bucket", "__n").agg(F.min(start).alias(start), F.max(end).alias(end))
    last = counted.groupBy(*keys, "__bucket").agg(F.max("__n").alias("__n")).withColumn("__open", F.last(F.when(F.col("__n") > 0, F.struct("__bucket", "__n")), ignorenulls=True).over(buckets))
    island = F.when(F.col("__n") > 0, F.struct("__bucket", "__n")).otherwise(F.col("__open"))
    return beside(counted, last, "__open").withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def placed_spans(span_rows: DataFrame, segments: DataFrame, options: MaskOptions = MaskOptions()) -> DataFrame:  # noqa: B008
    """Span rows with their segment and ``intervals``: array<struct<start, end, mode>>, null for spans that cannot be placed.

    Of segments with one id the last by ``_pos`` counts.  Also has has_words (null without
    a segment) and source_audio.
    """
    last = segments.filter(F.trim(F.coalesce("segment_id", F.lit(""))) != "").groupBy(F.trim("segment_id").alias("seg")).agg(F.max_by(F.struct("audio_path", "text", "start", "end", "words"), "_pos").alias("segment"))
    both = span_rows.withColumn("segment_id", F.trim(F.coalesce("segment_id", F.lit("")))).join(last, F.col("segment_id") == F.col("seg"), "left").drop("seg")
    s = F.col("segment")
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.coalesce(s["text"], F.lit("")))
    both = both.withColumns({"spans": F.coalesce("spans", no_spans()), "text": text, "source_audio": F.when(F.coalesce("audio_path", F.lit("")) != "", F.col("audio_path")).otherwise(s["audio_path"])})
    both = both.filter(F.coalesce("source_audio", F.lit("")) != "")
    # words are only mapped where there is something to place
    both = both.withColumn("places", F.when((F.size("spans") > 0) & s["start"].isNotNull() & s["end"].isNotNull(), times.word_places(F.col("text"), s["words"])))
    place = lambda x: times.span_interval(x, F.col("text"), s["start"], s["end"], F.col("places"), lead=options.lead, tail=options.tail, least=options.least)
    both = both.withColumn("intervals", F.when(F.col("places").isNull(), F.transform("spans", lambda x: F.lit(None).cast("struct<start: double, end: double, mode: string>"))).otherwise(F.transform("spans", place)))
    return both.withColumn("has_words", F.when(s.isNotNull(), F.size(times.usable_words(s["words"])) > 0)).drop("segment", "places")


def audit_sources(placed: DataFrame, options: MaskOptions = MaskOptions(), *, pos: str = "_pos") -> DataFrame:  # noqa: B008
    """One row for each source: its segments, spans by how they were placed, and its merged intervals.

    ``placed`` comes from ``placed_spans`` and has ``pos``, the order of the span rows.
    Only the ten first segment ids and the joined intervals of a source are gathered.
    """
    ids = F.when(F.col("segment_id") != "", F.struct(F.col(pos), F.col("segment_id")))
    mode = lambda m: F.size(F.filter("intervals", lambda x: x["mode"] == m))
    total = lambda c: F.sum(c).cast("int")
    counts = placed.groupBy("source_audio").agg(
        F.count("*").cast("int").alias("segments_count"),
        F.min_by("segment_id", F.when(F.col("segment_id") != "", F.col(pos))).alias("first_segment_id"),
        F.max_by("segment_id", F.when(F.col("segment_id") != "", F.col(pos))).alias("last_segment_id"),
        total(F.size("spans")).alias("masked_span_count"),
        total(F.size(F.filter("intervals", lambda x: x.isNull()))).alias("unmapped_spans"),
        F.count_if("has_words").cast("int").alias("segments_with_words"),
        F.count_if(~F.col("has_words")).cast("int").alias("segments_without_words"),
        total(mode("word")).alias("word_aligned_spans"),
        total(mode("char_ratio")).alias("ratio_aligned_spans"),
        total(F.size(F.filter("intervals", lambda x: x["end"] > x["start"]))).alias("intervals_count_raw"),
    )
    sample = placed.filter(ids.isNotNull()).select("source_audio", F.col(pos).alias("at"), "segment_id").withColumn("n", F.row_number().over(Window.partitionBy("source_audio").orderBy("at")))
    sample = sample.filter("n <= 10").groupBy("source_audio").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "segment_id"))), lambda x: x["segment_id"]).alias("sample_segment_ids"))
    raw = placed.select("source_audio", F.explode("intervals").alias("i")).filter("i IS NOT NULL").select("source_audio", "i.start", "i.end")
    merged = merge_intervals(raw, ["source_audio"], gap=options.gap)
    merged = merged.groupBy("source_audio").agg(F.count("*").cast("int").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("sec"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all_intervals"))
    out = counts.join(sample, "source_audio", "left").join(merged, "source_audio", "left")
    listed = F.transform(F.slice("all_intervals", 1, MOST_LISTED), lambda x: F.struct(F.round(x["start"], 3).alias("start"), F.round(x["end"], 3).alias("end")))
    nothing = F.expr(f"cast(array() as {times.INTERVALS})")
    return out.select(
        "source_audio", "segments_count", "first_segment_id", "last_segment_id", F.coalesce("sample_segment_ids", F.array().cast("array<string>")).alias("sample_segment_ids"),
        "masked_span_count", "unmapped_spans", "segments_with_words", "segments_without_words", "word_aligned_spans", "ratio_aligned_spans", "intervals_count_raw",
        F.coalesce("n", F.lit(0)).alias("intervals_count_merged"), F.coalesce("sec", F.lit(0.0)).alias("masked_duration_sec"), F.coalesce(listed, nothing).alias("time_intervals_sec"), F.coalesce("all_intervals", nothing).alias("all_intervals"),
    )


def mask_totals(audit: DataFrame) -> DataFrame:
    """One row about a masking run."""
    how = lambda m: F.count_if(F.col("method") == m)
    return audit.agg(
        F.count("*").alias("items"), F.count_if(F.col("method").like("time_aligned_%")).alias("files_masked"), how("copy_no_detected_spans").alias("files_copied_no_spans"), how("fallback_copy_after_mask_error").alias("files_failed_mask"),
        how("source_missing").alias("files_missing"), F.coalesce(F.sum("word_aligned_spans"), F.lit(0)).alias("word_aligned_spans"), F.coalesce(F.sum("ratio_aligned_spans"), F.lit(0)).alias("ratio_aligned_spans"),
        F.count_if((F.col("segments_count") > 0) & (F.col("segments_with_words") == 0)).alias("sources_without_word_timestamps"),
    )


# --------------------------------------------------------------------------------- audio


def read_wave(data: bytes) -> tuple[np.ndarray, wave._wave_params]:
    """Samples (frames by channels) of PCM audio of 8, 16, 24 or 32 bits, as they are; those of 24 bits in 32."""
    with wave.open(io.BytesIO(data)) as f:
        params = f.getparams()
        raw = f.readframes(params.nframes)
    kinds = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}
    if params.sampwidth == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(wide) * 3].reshape(-1, 3)
        samples = wide.reshape(-1).view("<i4") >> 8
    elif params.sampwidth in kinds:
        samples = np.frombuffer(raw, kinds[params.sampwidth])
    else:
        raise ValueError(f"samples of {params.sampwidth} bytes are not supported")
    return samples.reshape(-1, params.nchannels).copy(), params


def write_wave(samples: np.ndarray, params) -> bytes:
    raw = np.ascontiguousarray(samples).tobytes()
    if params.sampwidth == 3:
        raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    with wave.open(out := io.BytesIO(), "wb") as f:
        f.setnchannels(params.nchannels)
        f.setsampwidth(params.sampwidth)
        f.setframerate(params.framerate)
        f.writeframes(raw)
    return out.getvalue()


def mask_wave(data: bytes, intervals: list[tuple[float, float]], options: MaskOptions = MaskOptions()) -> bytes:  # noqa: B008
    """The audio with silence or a tone in the intervals, to the sample.  It keeps its length, rate, channels and width."""
    samples, params = read_wave(data)
    zero, top = (128, 127) if params.sampwidth == 1 else (0, float(2 ** (8 * params.sampwidth - 1) - 1))
    for start, end in intervals:
        a, b = max(0, round(start * params.framerate)), min(len(samples), round(end * params.framerate))
        if b <= a:
            continue
        samples[a:b] = zero
        if options.mode == "beep":
            tone = options.beep_amplitude * np.sin(2 * np.pi * options.beep_hz * np.arange(b - a) / params.framerate)
            samples[a:b] = (zero + tone * top).round().astype(samples.dtype)[:, None]
    return write_wave(samples, params)


def masked_name(source: str, root: str = "") -> tuple[str, str]:
    """Where a source's masked and unmasked copies go: its path under ``root``, else its name alone."""
    inside = posixpath.relpath(source, root) if root and (source == root or source.startswith(root.rstrip("/") + "/")) else (source if not source.startswith("/") and "://" not in source else posixpath.basename(source))
    stem = inside[: inside.rindex(".")] if "." in posixpath.basename(inside) else inside
    return f"{stem}.masked.wav", inside


def mask_files(audit: DataFrame, out_uri: str, options: MaskOptions = MaskOptions(), *, root: str = "") -> DataFrame:  # noqa: B008
    """The audit with masked_audio, method, mask_mode, mask_engine and mask_error: every source masked, or copied if it has no intervals.

    One that cannot be masked is copied, too, unless ``options.on_error`` is ``refuse``:
    then nothing of it is written.

    A file is read and written in one task, whole under another name first, so that a
    repeated task leaves no torn file.  Sources and ``out_uri`` are paths that executors
    share, with or without a scheme.
    """
    from pyarrow import fs as pafs

    def opened(uri: str):
        if uri.startswith("file:"):
            uri = "/" + uri[5:].lstrip("/")
        return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else posixpath.join(root or "/", uri))

    def put(uri: str, data: bytes) -> None:
        files, path = opened(uri)
        files.create_dir(posixpath.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as out:
            out.write(data)
        files.move(part, path)

    def one(source: str, intervals) -> tuple:
        files, path = opened(source)
        if files.get_file_info(path).type != pafs.FileType.File:
            return None, "source_missing", None, None
        with files.open_input_stream(path) as stream:
            data = stream.read()
        masked, plain = (posixpath.join(out_uri, n) for n in masked_name(source, root))
        wanted = [(x["start"], x["end"]) for x in intervals]
        if not wanted:
            put(plain, data)
            return plain, "copy_no_detected_spans", None, None
        try:
            put(masked, mask_wave(data, wanted, options))
        except (wave.Error, ValueError, EOFError) as e:
            if options.on_error == "refuse":
                return None, "refused_after_mask_error", None, str(e) or type(e).__name__
            put(plain, data)
            return plain, "fallback_copy_after_mask_error", None, str(e) or type(e).__name__
        return masked, f"time_aligned_{options.mode}_mask", "wave", None

    def run(batches):
        for batch in batches:
            found = [one(s, i) for s, i in zip(batch["source_audio"], batch["all_intervals"], strict=True)]
            yield pd.DataFrame([(s, *f) for s, f in zip(batch["source_audio"], found, strict=True)], columns=["source_audio", "masked_audio", "method", "mask_engine", "mask_error"])

    done = audit.select("source_audio", "all_intervals").mapInPandas(run, "source_audio string, masked_audio string, method string, mask_engine string, mask_error string")
    return audit.join(done, "source_audio").withColumn("mask_mode", F.lit(options.mode)).drop("all_intervals")
