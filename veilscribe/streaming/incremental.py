"""Incremental stages as Structured Streaming: recognition that resumes, detection on arrival, and masks by event time.

Checkpoints say which inputs are done; ids are unique over restarts; a batch that is
repeated writes its own folder again instead of appending to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from veilscribe import schemas
from veilscribe.operators.detect import detect
from veilscribe.operators.recognition import Engine, Policy, transcribe
from veilscribe.shared import checkpointed
from veilscribe.sources.files import exists


def recognise_arrivals(spark: SparkSession, manifests: str, out: str, checkpoint: str, make: Callable[[], Engine], policy: Policy = Policy(), *, files_per_batch: int | None = None) -> StreamingQuery:  # noqa: B008
    """Transcribe the items of manifest files that have not been seen, then stop.

    Segment ids go by batch and place, ``seg_<batch>_<number>``, so that none is given
    twice; items that come again are left out.  Items that fail go to ``<out>_failed``
    and are tried again when they are listed again.
    """
    reader = spark.readStream.schema(schemas.MANIFEST)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    items = reader.json(manifests).filter(F.coalesce("audio_path", F.lit("")) != "")

    def each(batch: DataFrame, number: int) -> None:
        done = _done(spark, out, number)
        fresh = batch.dropDuplicates(["item_id"]).join(done, "item_id", "left_anti")
        found = transcribe(fresh, make, policy, checkpoint=checkpointed)
        order = F.format_string(f"seg_{number:06d}_%016x", F.xxhash64("source_item_id", "audio_path", "start", "end", "text"))
        found.filter("error IS NULL").drop("error").select(order.alias("segment_id"), "*").write.mode("overwrite").parquet(f"{out}/batch={number}")
        failed = found.filter("error IS NOT NULL").select(F.col("source_item_id").alias("item_id"), "audio_path", "error")
        failed.write.mode("overwrite").parquet(f"{out}_failed/batch={number}")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(spark: SparkSession, out: str, number: int) -> DataFrame:
    """Items of earlier batches."""
    if number == 0 or not exists(spark, f"{out}/batch=*"):
        return spark.createDataFrame([], "item_id string")
    rows = spark.read.parquet(out)
    return rows.filter(F.col("batch") < number).select(F.col("source_item_id").alias("item_id")).distinct()


def detect_arrivals(spark: SparkSession, segments: str, out: str, checkpoint: str, *, delay: str = "1 day", **options) -> StreamingQuery:
    """Spans of segments as they arrive, each segment id once within the watermark.  Stops when all is done.

    ``segments`` is a folder of JSON lines with the segment schema and ``arrived``.
    """
    schema = StructType([*schemas.SEGMENTS.fields, StructField("arrived", TimestampType())])
    arriving = spark.readStream.schema(schema).json(segments).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["segment_id"])
    found = detect(arriving, **options).select("segment_id", "audio_path", "text", "spans")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def mask_sessions(intervals: DataFrame, *, by: str, at: str = "at", gap: str = "50 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Intervals of a stream joined by session windows: by, start, end, n of runs without a gap of ``gap``."""
    window = F.session_window(F.col(at), F.lit(gap))
    return intervals.withWatermark(at, delay).groupBy(F.col(by), window).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
