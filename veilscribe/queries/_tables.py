"""Tables, and transcripts made of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores by a hash of all their columns, for costly work on each: a file with one row group is one task else, however large."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*rows.columns))


def seconds(ts: str = "ts") -> Column:
    """Seconds since 2024 began, to the microsecond, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / 1e6


#: The same in DuckDB.
SECONDS_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed rows: user_id, event_id, event_type, start, end (its value in seconds later)."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", seconds().alias("start"), (seconds() + F.col("value")).alias("end"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as scored utterances: the lines of an order are up to seven models."""
    # by order before all sums: a task's sums are those of its orders, where a row group's would be held whole
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("seg_id"), F.concat(F.lit("m"), F.col("l_linenumber")).alias("model")).agg(
        F.min("l_returnflag").alias("session"), F.min("l_linestatus").alias("language"), F.max(F.round(F.col("l_discount") * 500, 2)).alias("wer"), F.max(F.round(F.col("l_tax") * 700, 2)).alias("cer"),
        F.max("l_quantity").alias("audio_dur_sec"), F.max(F.round(F.col("l_extendedprice") / 5000, 2)).alias("inference_sec"), F.max(F.col("l_partkey") % 11).alias("hits"), F.max(F.col("l_suppkey") % 5).alias("substitutions"),
    )


UTTERANCES_SQL = """utterances AS (
  SELECT l_orderkey AS seg_id, 'm' || l_linenumber AS model, min(l_returnflag) AS session, min(l_linestatus) AS language, max(round(l_discount * 500, 2)) AS wer, max(round(l_tax * 700, 2)) AS cer,
    max(l_quantity) AS audio_dur_sec, max(round(l_extendedprice / 5000, 2)) AS inference_sec, max(l_partkey % 11) AS hits, max(l_suppkey % 5) AS substitutions
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def conversation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored conversations: numbers made of their ids and lengths."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("item_id"), F.col("lang").alias("language"), "source", (F.col("n_chars") / 15.0).alias("duration_sec"), (F.col("doc_id") * 37 % 101 / 80.0).alias("wer"), (F.col("doc_id") * 53 % 97 / 70.0).alias("cer"),
        (F.col("n_chars") % 97 + 1).alias("ref_word_tokens"), (F.col("n_chars") % 89).alias("hyp_word_tokens"), (F.col("doc_id") % 13).alias("tag_fil"),
    )


SCORES_SQL = """scores AS (
  SELECT CAST(doc_id AS VARCHAR) AS item_id, lang AS language, source, n_chars / 15.0 AS duration_sec, CAST(doc_id * 37 % 101 AS DOUBLE) / 80.0 AS wer, CAST(doc_id * 53 % 97 AS DOUBLE) / 70.0 AS cer,
    n_chars % 97 + 1 AS ref_word_tokens, n_chars % 89 AS hyp_word_tokens, doc_id % 13 AS tag_fil
  FROM documents)"""


def round_sql(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does: the binary number times a power of ten, halves away from zero.  Spark's own rounding takes the shortest decimal form, which may be a half where the number is none."""
    scaled = x * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(x)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, so that the order of a sum does not show."""
    return frame.select(*((round_sql(F.col(c), digits) if kind == "double" else F.col(c)).alias(c) for c, kind in frame.dtypes))
