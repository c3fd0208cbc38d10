"""Time axes: windows, chunks, alignment, interval unions, mask audits, chunk texts and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.functions import times
from veilscribe.operators import masking, recognition
from veilscribe.queries._tables import SECONDS_SQL, events, rounded, table
from veilscribe.shared import checkpointed


def q_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as intervals of their value in hours, joined at gaps of up to 10 minutes."""
    rows = events(spark, sf_dir).withColumn("end", F.col("start") + F.col("value") * 36)
    merged = masking.merge_intervals(rows, ["user_id"], gap=600.0, bucket_sec=86_400.0)
    return rounded(merged.withColumnRenamed("start", "start_sec").withColumnRenamed("end", "end_sec"), 3)


def q_interval_merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within a row of arrays."""
    rows = events(spark, sf_dir).filter("value > 0").groupBy("user_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("value") * 36).alias("end"))).alias("all"))
    out = rows.select("user_id", F.explode(times.merge_in_row(F.col("all"), 600.0)).alias("i")).select("user_id", F.col("i.start").alias("start_sec"), F.col("i.end").alias("end_sec"))
    return rounded(out, 3)


def _durations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("d"))


def q_clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings, cut into windows of 12 seconds."""
    out = _durations(spark, sf_dir).select("doc_id", F.explode(times.clip_windows(F.lit(0.0), F.col("d"), 12.0)).alias("w"))
    return rounded(out.select("doc_id", F.col("w.start").alias("start_sec"), F.col("w.end").alias("end_sec")))


def q_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings, cut into chunks of 20 seconds that overlap by 2."""
    out = _durations(spark, sf_dir).select("doc_id", F.explode(times.chunk_ranges(F.col("d"), 20.0, 2.0, 1.5)).alias("w"))
    return rounded(out.select("doc_id", F.col("w.start").alias("start_sec"), F.col("w.end").alias("end_sec")))


def q_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings with a transcript of one letter for each character, in chunks of 28 seconds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("duration_sec"), F.repeat(F.lit("x"), (F.col("n_chars") % 1000 + 1).cast("int")).alias("transcript"))
    chunks = recognition.chunk_table(docs, key="doc_id")
    return rounded(chunks.select("doc_id", "chunk_id", "start_sec", "end_sec", F.length("transcript").alias("n")))


def q_align_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of each document in time, by its share of the text."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), "text", (F.col("n_chars") / 15.0).alias("d"))
    span = F.struct(F.floor(F.col("n") / 4).cast("int").alias("start"), F.floor(F.col("n") / 2).cast("int").alias("end"), F.lit("NAME").alias("type"), F.lit("Ann").alias("text"))
    i = times.span_interval(span, F.col("text"), F.lit(0.0), F.col("d"), F.expr(f"cast(array() as {times.WORD_PLACES})"))
    return rounded(docs.select("doc_id", i.alias("i")).select("doc_id", F.col("i.start").alias("start_sec"), F.col("i.end").alias("end_sec"), "i.mode"))


def q_char_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in time: a user's events are words of 4 characters, 10 apart; one asks for places before, in and between them."""
    ranked = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "event_id", "end"))).alias("e"))
    places = F.transform("e", lambda x, i: F.struct((i * 10 + 1).cast("int").alias("start_char"), (i * 10 + 5).cast("int").alias("end_char"), x["start"].alias("start_sec"), x["end"].alias("end_sec"), F.lit("").alias("text")))
    asked = F.explode(F.array(*map(F.lit, (0, 3, 8, 15, 27, 31, 38, 1_000_000))))
    out = ranked.withColumn("places", places).withColumn("place", asked)
    return rounded(out.select("user_id", "place", times.char_time(F.col("place"), F.col("places")).alias("sec")), 4)


def q_word_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans placed by word timestamps: the third word of three that are a second each."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('say ', o_orderstatus, ' ', o_orderpriority, '.') AS text", "o_orderpriority AS p", "o_orderstatus AS s")
    word = lambda t, i: F.struct(t.alias("word"), F.lit(float(i)).alias("start"), F.lit(i + 0.75).alias("end"), F.lit(None).cast("double").alias("probability"))
    words = F.array(word(F.lit("say"), 0), word(F.concat(F.lit(" "), F.col("s")), 1), word(F.concat(F.lit(" "), F.col("p"), F.lit(".")), 2))
    n = F.length("text")
    span = F.struct((n - F.length("p") - 1).alias("start"), (n - 1).alias("end"), F.lit("ID").alias("type"), F.col("p").alias("text"))
    i = times.span_interval(span, F.col("text"), F.lit(0.0), F.lit(4.0), times.word_places(F.col("text"), words))
    return rounded(o.select("o_orderkey", i.alias("i")).select("o_orderkey", F.col("i.start").alias("start_sec"), F.col("i.end").alias("end_sec"), "i.mode"))


def q_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments with one span each: the audit of each user's recording."""
    rows = events(spark, sf_dir).withColumn("ok", F.col("value") > 0.5)
    found = F.when(F.col("ok"), F.struct("start", F.col("end"), F.when(F.col("event_id") % 2 == 0, "word").otherwise("char_ratio").alias("mode")))
    span = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("ID").alias("type"), F.lit("x").alias("text"), F.lit(None).cast("double").alias("score"), F.lit("rule").alias("source"))
    placed = rows.select(F.col("user_id").cast("string").alias("source_audio"), F.col("event_id").cast("string").alias("segment_id"), F.col("event_id").alias("_pos"), F.array(span).alias("spans"), F.array(found).alias("intervals"), (F.col("event_id") % 2 == 0).alias("has_words"))
    audit = masking.audit_sources(placed)
    return audit.select("source_audio", "segments_count", "first_segment_id", "last_segment_id", F.array_join("sample_segment_ids", ",").alias("sample"), "masked_span_count", "unmapped_spans", "segments_with_words", "segments_without_words", "word_aligned_spans", "ratio_aligned_spans", "intervals_count_raw", "intervals_count_merged", "masked_duration_sec")


def q_mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a masking run over those audits."""
    audit = q_mask_audit(spark, sf_dir)
    how = F.when(F.col("intervals_count_merged") > 0, "time_aligned_silence_mask").otherwise("copy_no_detected_spans")
    return masking.mask_totals(audit.withColumn("method", how))


def q_overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three chunks that overlap by five words, and one that does not, as one."""
    words = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.concat(F.lit("w"), F.col("o_orderkey") * 100 + i)), " ")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", times.merge_chunk_texts(F.array(words(1, 20), words(16, 30), F.concat(F.lit(" "), words(26, 40)), words(60, 63))).alias("text"))


def q_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles of three lines for each order."""
    seg = lambda i: F.struct((F.col("o_orderkey") * 1.25 + i).alias("start_sec"), (F.col("o_orderkey") * 1.25 + i + 0.5).alias("end_sec"), F.col("o_orderstatus").alias("text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.md5(times.srt(F.array(seg(0), seg(1), seg(2)))).alias("srt_md5"))


def q_stamped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between time tokens, with an open end."""
    tokens = F.array(F.lit("<|zh|>"), F.lit("<|0.5|>"), F.lit("a"), F.col("o_orderstatus"), F.lit("<|2|>"), F.lit("<|2.5|>"), F.lit("b"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(times.stamped_segments(tokens, F.lit(10.0), F.lit(30.0))).alias("s"))
    return out.select("o_orderkey", "s.start_sec", "s.end_sec", "s.text")


def q_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser that plays back tables: two files for each nation, windows of 12 seconds, and mixed segments decoded again."""
    inputs = table(spark, sf_dir, "nation").selectExpr("concat('item', n_nationkey) AS item_id", "concat('bad' , n_nationkey) AS audio_path").filter("item_id < 'item2'")
    fine = table(spark, sf_dir, "nation").selectExpr("concat('file', n_nationkey) AS item_id", "concat('f', n_nationkey % 3) AS audio_path")
    rows = [
        {"audio_path": "f0", "text": "hello there", "start": 0.0, "end": 5.0, "words": []}, {"audio_path": "f1", "text": "你好 hi", "start": 1.0, "end": 4.0, "words": [], "language": None},
        {"audio_path": "f1", "text": "long", "start": 5.0, "end": 30.0, "words": []}, {"audio_path": "f1", "text": "你好嗨", "start": 1.0, "end": 4.0, "words": [], "language": "zh"},
    ]
    found = recognition.transcribe(inputs.unionByName(fine), recognition.replay(rows), recognition.Policy(longest=12.0, mixed_redecode=True, fallback="zh"), checkpoint=checkpointed)
    return found.groupBy("language", "decode_mode", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_interval_merge, q_interval_merge_rows, q_clip_windows, q_chunk_ranges, q_fixed_chunks, q_align_ratio, q_char_time, q_word_align, q_mask_audit, q_mask_totals, q_overlap_merge, q_srt, q_stamped_segments, q_recognise)}

_MERGE = f"""
WITH s AS (SELECT user_id, {SECONDS_SQL} AS a, {SECONDS_SQL} + value * 36 AS b FROM events WHERE value > 0),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, round(min(a), 3) AS start_sec, round(max(b), 3) AS end_sec FROM i GROUP BY user_id, island"""

_AUDIT = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_id, value > 0.5 AS ok, {SECONDS_SQL} AS a, {SECONDS_SQL} + value AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY u ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WHERE ok),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT u, island, max(b) - min(a) AS sec FROM i GROUP BY u, island),
t AS (SELECT u, count(*) AS n, sum(sec) AS sec FROM g GROUP BY u),
c AS (
  SELECT u, count(*) AS n_all, min(event_id) AS lo, max(event_id) AS hi, list(event_id ORDER BY event_id)[1:10] AS few, count(*) FILTER (NOT ok) AS un, count(*) FILTER (event_id % 2 = 0) AS w, count(*) FILTER (ok AND event_id % 2 = 0) AS ow, count(*) FILTER (ok AND event_id % 2 <> 0) AS orr, count(*) FILTER (ok) AS okn
  FROM e GROUP BY u)
SELECT c.u AS source_audio, CAST(n_all AS INTEGER) AS segments_count, CAST(lo AS VARCHAR) AS first_segment_id, CAST(hi AS VARCHAR) AS last_segment_id, array_to_string(few, ',') AS sample, CAST(n_all AS INTEGER) AS masked_span_count, CAST(un AS INTEGER) AS unmapped_spans,
  CAST(w AS INTEGER) AS segments_with_words, CAST(n_all - w AS INTEGER) AS segments_without_words, CAST(ow AS INTEGER) AS word_aligned_spans, CAST(orr AS INTEGER) AS ratio_aligned_spans, CAST(okn AS INTEGER) AS intervals_count_raw,
  CAST(coalesce(t.n, 0) AS INTEGER) AS intervals_count_merged, coalesce(round(t.sec, 3), 0) AS masked_duration_sec
FROM c LEFT JOIN t ON t.u = c.u"""

SQL = {
    "q_interval_merge": _MERGE,
    "q_interval_merge_rows": _MERGE,
    "q_clip_windows": "WITH d AS (SELECT doc_id, n_chars / 15.0 AS d FROM documents WHERE n_chars > 0), w AS (SELECT doc_id, d, unnest(range(0, CAST(ceil(d / 12) AS BIGINT))) AS i FROM d) SELECT doc_id, CAST(i * 12 AS DOUBLE) AS start_sec, round(least(d, (i + 1) * 12), 6) AS end_sec FROM w",
    "q_chunk_ranges": "WITH d AS (SELECT doc_id, n_chars / 15.0 AS d FROM documents WHERE n_chars > 0), w AS (SELECT doc_id, d, unnest(range(0, greatest(0, CAST(ceil((d - 20) / 18) AS BIGINT)) + 1)) AS i FROM d) SELECT doc_id, CAST(i * 18 AS DOUBLE) AS start_sec, round(least(d, i * 18 + 20), 6) AS end_sec FROM w WHERE least(d, i * 18 + 20) - i * 18 >= 1.5",
    "q_fixed_chunks": """
WITH d AS (SELECT doc_id, n_chars / 15.0 AS d, n_chars % 1000 + 1 AS len, CAST(ceil(n_chars / 15.0 / 28) AS BIGINT) AS n FROM documents WHERE n_chars / 15.0 >= 2),
w AS (SELECT *, unnest(range(0, n)) AS i FROM d),
s AS (SELECT *, CAST(round_even(CAST(i * len AS DOUBLE) / n, 0) AS BIGINT) AS a, CAST(round_even(CAST((i + 1) * len AS DOUBLE) / n, 0) AS BIGINT) AS b, greatest(0, i * len // n - 5) AS wa, least(len, (i + 1) * len // n + 5) AS wb FROM w)
SELECT doc_id, doc_id || '_c' || lpad(CAST(i AS VARCHAR), 3, '0') AS chunk_id, CAST(i * 28 AS DOUBLE) AS start_sec, round(least((i + 1) * 28, d), 6) AS end_sec, CAST(CASE WHEN b > a THEN b - a ELSE wb - wa END AS INTEGER) AS n FROM s WHERE least((i + 1) * 28, d) - i * 28 >= 2""",
    "q_align_ratio": """
WITH d AS (SELECT doc_id, length(text) AS n, n_chars / 15.0 AS d FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, d, n, CASE WHEN n > 0 THEN least(n // 4, n) ELSE 0 END AS i, CASE WHEN n > 0 THEN greatest(n // 4 + 1, n // 2) ELSE 1 END AS j FROM d),
a AS (SELECT doc_id, d, CASE WHEN n > 0 THEN CAST(i AS DOUBLE) / n * d ELSE 0 END AS s, least(d, CASE WHEN n > 0 THEN CAST(j AS DOUBLE) / n * d ELSE d END + 0.12) AS e FROM p WHERE d > 0
  UNION ALL SELECT doc_id, d, NULL, NULL FROM p WHERE NOT d > 0)
SELECT doc_id, round(CASE WHEN e - s < 0.2 THEN greatest(0, 0.5 * (s + e) - 0.1) ELSE s END, 6) AS start_sec, round(CASE WHEN e - s < 0.2 THEN least(d, 0.5 * (s + e) + 0.1) ELSE e END, 6) AS end_sec, CASE WHEN s IS NOT NULL THEN 'char_ratio' END AS mode FROM a""",
    "q_char_time": f"""
WITH e AS (SELECT user_id, {SECONDS_SQL} AS a, {SECONDS_SQL} + value AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
w AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY i) AS b0 FROM e),
q AS (SELECT DISTINCT user_id, place FROM events, (SELECT unnest([0, 3, 8, 15, 27, 31, 38, 1000000]) AS place)),
h AS (SELECT q.user_id, q.place, min(w.i) AS i FROM q JOIN w ON w.user_id = q.user_id AND w.i * 10 + 5 >= q.place GROUP BY q.user_id, q.place)
SELECT q.user_id, CAST(q.place AS INTEGER) AS place, round(CASE WHEN w.i IS NULL THEN NULL WHEN w.i * 10 + 1 <= q.place THEN w.a + (q.place - w.i * 10 - 1) / 4.0 * (w.b - w.a) WHEN w.i > 0 AND w.a >= w.b0 THEN w.b0 + (q.place - (w.i * 10 - 5)) / 6.0 * (w.a - w.b0) END, 4) AS sec
FROM q LEFT JOIN h ON h.user_id = q.user_id AND h.place = q.place LEFT JOIN w ON w.user_id = h.user_id AND w.i = h.i""",
    "q_word_align": """
SELECT o_orderkey, round(2 + 0.75 / (length(o_orderpriority) + 2), 6) AS start_sec, round(2 + 0.75 * (length(o_orderpriority) + 1) / (length(o_orderpriority) + 2) + 0.12, 6) AS end_sec, 'word' AS mode FROM orders""",
    "q_mask_audit": _AUDIT,
    "q_mask_totals": f"""
WITH audit AS ({_AUDIT})
SELECT count(*) AS items, count(*) FILTER (intervals_count_merged > 0) AS files_masked, count(*) FILTER (intervals_count_merged = 0) AS files_copied_no_spans, CAST(0 AS BIGINT) AS files_failed_mask, CAST(0 AS BIGINT) AS files_missing,
  CAST(sum(word_aligned_spans) AS BIGINT) AS word_aligned_spans, CAST(sum(ratio_aligned_spans) AS BIGINT) AS ratio_aligned_spans, count(*) FILTER (segments_with_words = 0) AS sources_without_word_timestamps FROM audit""",
    "q_overlap_merge": "SELECT o_orderkey, array_to_string(list_transform(list_concat(range(1, 41), range(60, 64)), lambda i: 'w' || (o_orderkey * 100 + i)), ' ') AS text FROM orders",
    "q_srt": """
WITH s AS (SELECT o_orderkey, o_orderstatus, i, CAST(round_even((o_orderkey * 1.25 + i) * 1000, 0) AS BIGINT) AS a, CAST(round_even((o_orderkey * 1.25 + i + 0.5) * 1000, 0) AS BIGINT) AS b FROM orders, (SELECT unnest(range(0, 3)) AS i)),
f AS (SELECT o_orderkey, i, (i + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || o_orderstatus || chr(10) AS t FROM s)
SELECT o_orderkey, md5(string_agg(t, chr(10) ORDER BY i)) AS srt_md5 FROM f GROUP BY o_orderkey""",
    "q_stamped_segments": """
SELECT o_orderkey, CAST(CASE i WHEN 0 THEN 10.5 ELSE 12.5 END AS DOUBLE) AS start_sec, CAST(CASE i WHEN 0 THEN 12 ELSE 30 END AS DOUBLE) AS end_sec, CASE i WHEN 0 THEN 'a' || o_orderstatus ELSE 'b' END AS text FROM orders, (SELECT unnest([0, 1]) AS i)""",
    "q_recognise": """
WITH n AS (SELECT n_nationkey % 3 AS f, n_nationkey AS k FROM nation)
SELECT 'en' AS language, 'single_pass' AS decode_mode, false AS failed, CAST(sum(CASE f WHEN 0 THEN 1 WHEN 1 THEN 3 END) AS BIGINT) AS n FROM n
UNION ALL SELECT 'zh', 'single_pass', false, count(*) FILTER (f = 1) FROM n
UNION ALL SELECT 'zh', 'mixed_redecode', false, count(*) FILTER (f = 1) FROM n
UNION ALL SELECT 'mixed', 'mixed_redecode', false, count(*) FILTER (f = 1) FROM n
UNION ALL SELECT 'unknown', 'empty_segment', false, count(*) FILTER (f = 2) FROM n
UNION ALL SELECT 'unknown', NULL, true, count(*) FILTER ('item' || k < 'item2') FROM n""",
}
