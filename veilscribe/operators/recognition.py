"""Speech recognition around a pluggable engine: segments, refinement of long ones, and decoding mixed ones again.

An engine is made once per Python task and called as
``engine(audio_path, language, clip)`` with ``clip`` None or (start, end) in seconds; it
gives dictionaries with text, start, end, words and maybe language and probability.
``replay`` is the deterministic stand-in: it plays back a table of transcriptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscribe import schemas
from veilscribe.functions import times
from veilscribe.functions.text import decode_language, script_bucket, script_counts, strip
from veilscribe.operators.selection import segment_ids

Engine = Callable[[str, str | None, tuple[float, float] | None], list[dict]]
_DECODED = f"call long, audio_path string, text string, start double, end double, words array<{schemas.WORD}>, language string, probability double, error string"


@dataclass(frozen=True)
class Policy:
    """How segments are refined.  ``longest`` of 0 leaves long segments as they are."""

    language: str | None = None
    longest: float = 0.0
    overlap: float = 0.0
    mixed_redecode: bool = False
    allowed: tuple[str, ...] = ("en", "zh")
    fallback: str = "en"


def replay(rows: list[dict]) -> Callable[[], Engine]:
    """An engine that plays back rows with audio_path, text, start, end, words and language.

    With a clip it gives the rows that meet it; with a language, only rows of that
    language, or without one.  A path that starts with ``bad`` fails.
    """

    def make() -> Engine:
        by_path: dict[str, list[dict]] = {}
        for r in rows:
            by_path.setdefault(r["audio_path"], []).append(r)

        def engine(path: str, language: str | None, clip):
            if path.startswith("bad"):
                raise OSError(f"cannot decode {path}")
            return [r for r in by_path.get(path, []) if (language is None or r.get("language") in (None, language)) and (clip is None or (r["end"] > clip[0] and r["start"] < clip[1]))]

        return engine

    return make


def decode(calls: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """Decoded segments of calls (call, audio_path, language, clip_start, clip_end): text trimmed, clamped to the clip, without those that have no length.

    A call that fails gives one row with its error and no text, so that a bad file costs
    its own rows alone.
    """

    def words_of(raw) -> list[dict]:
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        return [{"word": str(w.get("word") or ""), "start": float(w["start"]), "end": float(w["end"]), "probability": float(w["probability"]) if number(w.get("probability")) else None} for w in raw or [] if number(w.get("start")) and number(w.get("end")) and w["end"] > w["start"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            out = []
            for call, path, language, a, b in batch.itertuples(index=False):
                clip = None if pd.isna(a) or pd.isna(b) else (float(a), float(b))
                try:
                    found = engine(path, language or None, clip)
                except Exception as e:  # noqa: BLE001  an engine may raise anything
                    out.append((call, path, None, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                for s in found:
                    start, end = float(s["start"]), float(s["end"])
                    if clip:
                        start, end = max(start, clip[0]), min(end, clip[1])
                    if end > start:
                        out.append((call, path, (s.get("text") or "").strip(), start, end, words_of(s.get("words")), s.get("language"), s.get("probability"), None))
            yield pd.DataFrame(out, columns=["call", "audio_path", "text", "start", "end", "words", "language", "probability", "error"]).astype({"start": "float64", "end": "float64", "probability": "float64"})

    return calls.select("call", "audio_path", "language", F.col("clip_start").cast("double"), F.col("clip_end").cast("double")).mapInPandas(run, _DECODED)


def _windows_again(segments: DataFrame, make, windows: Column, language: Column, overlap: float) -> DataFrame:
    """Segments decoded again in windows: seg, core_start and what the engine gives whose middle lies in its window."""
    core = segments.select("seg", "audio_path", language.alias("language"), F.explode(windows).alias("w")).select("seg", "audio_path", "language", F.col("w.start").alias("core_start"), F.col("w.end").alias("core_end"))
    keyed = core.withColumn("call", F.xxhash64("seg", "core_start"))
    clip = times.with_context(F.col("core_start"), F.col("core_end"), overlap)
    calls = keyed.select("call", "audio_path", "language", clip["start"].alias("clip_start"), clip["end"].alias("clip_end"))
    found = decode(calls, make).drop("audio_path", "language")
    both = keyed.select("seg", "core_start", "core_end", "call").join(found, "call")
    return both.filter(F.col("error").isNull() & times.owned(F.col("start"), F.col("end"), F.col("core_start"), F.col("core_end"))).select("seg", "text", "start", "end", "words")


def transcribe(inputs: DataFrame, make: Callable[[], Engine], policy: Policy = Policy(), *, checkpoint: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:  # noqa: B008
    """Segments without ids of inputs (item_id, audio_path): the columns of the segment schema but segment_id, and ``error``.

    Long segments are replaced by what decoding in windows gives, if it gives anything.
    Mixed ones are decoded again in the language of their script; where that fails they
    stay as they are.  A file without segments gives one row without text; one that fails
    gives a row with its error.  ``checkpoint`` is called on what engines have given, so
    that a costly decode is not done twice.
    """
    base = inputs.select("item_id", "audio_path").withColumn("call", F.xxhash64("item_id", "audio_path"))
    first = checkpoint(decode(base.select("call", "audio_path", F.lit(policy.language).alias("language"), F.lit(None).alias("clip_start"), F.lit(None).alias("clip_end")), make))
    joined = base.join(first.drop("audio_path"), "call", "left")
    failed = joined.filter("error IS NOT NULL")
    told = joined.filter("start IS NOT NULL").withColumn("seg", F.xxhash64("call", "start", "end", "text"))
    # the first row speaks for the language of the file
    info = told.groupBy("call").agg(F.min_by(F.struct("language", "probability"), F.struct("start", "end")).alias("info"))
    cols = ["item_id", "audio_path", "call", "seg", "text", "start", "end", "words"]
    segments = told.select(*cols)
    if policy.longest > 0:
        long = segments.filter(F.col("end") - F.col("start") > policy.longest)
        again = checkpoint(_windows_again(long, make, times.clip_windows(F.col("start"), F.col("end"), policy.longest), F.lit(policy.language), policy.overlap))
        replaced = long.select("item_id", "audio_path", "call", "seg").join(again, "seg").select(*cols)
        stayed = segments.join(again.select("seg").distinct(), "seg", "left_anti").select(*cols)
        segments = stayed.unionByName(replaced)
    single = segments.withColumns({"decode_mode": F.lit("single_pass"), "decode_language": F.lit(policy.language)})
    if policy.mixed_redecode:
        # refined segments need ids of their own
        single = single.withColumn("seg", F.xxhash64("call", "start", "end", "text"))
        mixed = single.filter(script_bucket("text") == "mixed").withColumn("decode_language", decode_language("text", list(policy.allowed), policy.fallback))
        whole = F.array(F.struct(F.col("start"), F.col("end")))
        again = checkpoint(_windows_again(mixed, make, whole, F.col("decode_language"), policy.overlap))
        redone = mixed.select("item_id", "audio_path", "call", "seg", "decode_language").join(again, "seg").withColumn("decode_mode", F.lit("mixed_redecode"))
        fell = mixed.join(again.select("seg").distinct(), "seg", "left_anti").withColumn("decode_mode", F.lit("mixed_base_fallback"))
        other = single.filter(script_bucket("text") != "mixed")
        order = [*cols, "decode_mode", "decode_language"]
        single = other.select(*order).unionByName(redone.select(*order)).unionByName(fell.select(*order))
    out = single.join(info, "call", "left")
    silent = base.join(single.select("call").distinct(), "call", "left_anti").join(failed.select("call").distinct(), "call", "left_anti")
    no_words = F.expr(f"cast(array() as array<{schemas.WORD}>)")
    made = [
        out.select(*_row(F.col("text"), F.col("words"), F.col("start"), F.col("end"), F.col("decode_mode"), F.col("decode_language"), F.col("info.language"), F.col("info.probability"), F.lit(None))),
        silent.select(*_row(F.lit(""), no_words, F.lit(0.0), F.lit(None), F.lit("empty_segment"), F.lit(policy.language), F.lit(None), F.lit(None), F.lit(None))),
        failed.select(*_row(F.lit(None), no_words, F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.col("error"))),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _row(text, words, start, end, mode, language, file_language, probability, error) -> list[Column]:
    counts = script_counts(text)
    return [
        F.col("item_id").alias("source_item_id"), F.col("audio_path"), text.cast("string").alias("text"), script_bucket(text).alias("language"), F.struct(counts["zh_chars"].cast("int").alias("zh_chars"), counts["en_chars"].cast("int").alias("en_chars")).alias("language_counts"),
        file_language.cast("string").alias("detected_file_language"), probability.cast("double").alias("detected_file_language_probability"), start.cast("double").alias("start"), end.cast("double").alias("end"), words.alias("words"),
        mode.cast("string").alias("decode_mode"), language.cast("string").alias("decode_language"), F.lit("asr").alias("source"), error.cast("string").alias("error"),
    ]


def with_segment_ids(segments: DataFrame, *, last: int = -1) -> DataFrame:
    """Segments in the order of item, time and text, with consecutive ids; failed files are left out."""
    good = segments.filter("error IS NULL").drop("error")
    return segment_ids(good, ["source_item_id", "start", "end", "text"], last=last).select("segment_id", *good.columns)


def refinement_counts(before: DataFrame, after: DataFrame, longest: float) -> DataFrame:
    """One row: long segments before, segments before and after."""
    a = before.agg(F.count("*").alias("segments_before"), F.count_if(F.col("end") - F.col("start") > longest).alias("long_segments"))
    return a.crossJoin(F.broadcast(after.agg(F.count("*").alias("segments_after"), F.count_if(F.col("decode_mode") == "mixed_redecode").alias("redecoded"))))  # one row each


def chunk_table(records: DataFrame, *, chunk: float = 28.0, shortest: float = 2.0, duration: str = "duration_sec", text: str = "transcript", key: str = "record_id") -> DataFrame:
    """Records cut into chunks of ``chunk`` seconds with their share of the transcript; key, chunk_id, start_sec, end_sec, transcript and the other columns."""
    cut = records.withColumn("__c", F.explode(times.fixed_chunks(F.col(duration), F.col(text), chunk, shortest)))
    rest = [c for c in records.columns if c not in (text, duration)]
    return cut.select(*rest, F.concat(F.col(key), F.format_string("_c%03d", F.col("__c.i"))).alias("chunk_id"), F.col("__c.start").alias("start_sec"), F.col("__c.end").alias("end_sec"), strip(F.col("__c.text")).alias("transcript"))


def merged_chunk_texts(chunks: DataFrame, by: str, *, order: str = "start_sec", text: str = "pred_text") -> DataFrame:
    """by, text: overlapping chunks of each recording as one text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return chunks.groupBy(by).agg(times.merge_chunk_texts(listed).alias("text"))
