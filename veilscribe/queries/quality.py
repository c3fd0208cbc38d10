"""Diagnostics and choices of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe.functions.text import ratio_mode
from veilscribe.operators import diagnostics as D
from veilscribe.operators import scoring, selection
from veilscribe.operators.transcripts import first_by_id
from veilscribe.queries._tables import SCORES_SQL, conversation_scores, rounded, table

_Q = ("Q1", "Q2", "Q3", "Q4")


def q_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted error rates by source."""
    rows = conversation_scores(spark, sf_dir).select(F.col("source").alias("run"), F.lit(1).alias("num_conversations"), "wer", "cer", "ref_word_tokens", F.col("hyp_word_tokens").alias("ref_chars"), (F.col("wer") / 10).alias("rtf"), F.col("duration_sec").alias("total_audio_sec"), F.col("tag_fil").alias("segments"))
    return rounded(D.weighted_rates(rows))


def q_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's share of a source's tokens."""
    rows = conversation_scores(spark, sf_dir).groupBy("source", "language").agg(F.sum("ref_word_tokens").alias("tokens"))
    return rounded(D.share_pct(rows, "tokens", ["source"], "token_share_pct"))


def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of error rates in one row."""
    return rounded(D.distribution(conversation_scores(spark, sf_dir), "wer"))


def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates in fixed bins, the last one closed."""
    return D.histogram(conversation_scores(spark, sf_dir), "wer", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


def q_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of three features with both error rates."""
    rows = conversation_scores(spark, sf_dir).withColumn("ratio", F.col("hyp_word_tokens") / F.col("ref_word_tokens")).withColumn("flat", F.lit(1.0))
    return rounded(D.correlations(rows, ["duration_sec", "ratio", "flat"], ["wer", "cer"]))


def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by quarter of the duration."""
    return rounded(D.by_quartile(conversation_scores(spark, sf_dir), "duration_sec", _Q, ["wer", "cer"]))


def q_ratio_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that generate too little, enough or too much."""


    rows = conversation_scores(spark, sf_dir).withColumn("ratio", F.col("hyp_word_tokens") / F.greatest(F.lit(1), F.col("ref_word_tokens")))
    return rounded(D.grouped_summary(rows.withColumn("ratio_mode", ratio_mode(F.col("ratio"))), "ratio_mode", ["ratio", "wer", "cer"]))


def q_error_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of error rates that may overlap."""
    return rounded(D.error_slices(conversation_scores(spark, sf_dir)))


def _turn_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    return c.select(F.col("conv_id").cast("string").alias("source_item_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + F.length(F.coalesce("text", F.lit(""))) / 100.0).alias("end"), F.when(F.col("role") == "user", "EN").when(F.col("role") == "assistant", "zh").alias("language"))


def q_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the turns of a conversation cover it; documents without turns have none."""
    return rounded(D.segmentation(conversation_scores(spark, sf_dir), _turn_segments(spark, sf_dir)))


def q_segment_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant language of each conversation's turns."""
    return rounded(D.segment_languages(conversation_scores(spark, sf_dir), _turn_segments(spark, sf_dir)).drop("wer", "cer", "duration_sec"))


def q_top_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with many fillers against the rest."""
    return rounded(D.top_quarter(conversation_scores(spark, sf_dir), "tag_fil", ["wer", "cer"]))


def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of error rates with duration by language."""
    return rounded(D.trend(conversation_scores(spark, sf_dir), "duration_sec", "wer", ["language"]))


def q_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative error rates by language."""
    return rounded(D.cumulative(conversation_scores(spark, sf_dir), "wer", ["language"]))


def q_manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents as a manifest."""
    docs = table(spark, sf_dir, "documents").select((F.col("n_chars") / 15.0).alias("duration_sec"), F.col("text").alias("transcript"))
    return rounded(D.manifest_stats(docs), 4)


def q_language_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mean_by_language(conversation_scores(spark, sf_dir), "wer", "cer")


def q_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents are unfit as short training clips."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("transcript"), (F.col("n_chars") / 15.0).alias("duration_sec"))
    return D.drop_reasons(docs).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------- choices of rows


def q_duration_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of documents of about 1,000 minutes or at most 300."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("duration_sec"))
    return rounded(selection.duration_budget(docs, target_sec=60_000.0, most_items=300, key="doc_id"), 4)


def q_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to five folds."""
    return selection.folds(table(spark, sf_dir, "documents").select("doc_id"), 5, key="doc_id")


def q_segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered in order, after the hundred that are there."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").filter("conv_id IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    return selection.segment_ids(turns.drop("role"), ["conv_id", "turn"], last=99)


def q_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label yet, and how many of each language have one."""
    docs, done = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    todo = selection.unprocessed(docs.withColumn("item_id", F.col("doc_id").cast("string")), done, done_key="doc_id")
    again = selection.already_processed(docs.withColumn("item_id", F.col("doc_id").cast("string")), done, done_key="doc_id")
    return todo.groupBy("lang").agg(F.count("*").alias("n")).withColumn("state", F.lit("todo")).unionByName(again.groupBy("lang").agg(F.count("*").alias("n")).withColumn("state", F.lit("done")))


def q_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is in neither of two exclusion lists."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("utt_id"))
    manifest = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("utt_id"), F.concat(F.lit("a_b_"), F.col("doc_id")).alias("item_id"))
    ids = table(spark, sf_dir, "pages").select(F.concat(F.lit(" "), F.col("page_id")).alias("utt_id"))
    return selection.without(docs, selection.excluded_ids(manifest, ids), "utt_id")


def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events with one user and type the first."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("segment_id"), "event_id", "value")
    return first_by_id(e, "segment_id", "event_id")


def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events with one user and type the last."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("segment_id"), "event_id", "value")
    return scoring.last_wins(e, "segment_id", "event_id")


def q_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst conversations."""
    return rounded(selection.worst(conversation_scores(spark, sf_dir), "wer", 10, [F.desc("ref_word_tokens"), "item_id"]).select("item_id", "wer"))


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conversations of a decent band, nearest to its middle."""
    return rounded(selection.nearest(conversation_scores(spark, sf_dir), "wer", 0.0, 0.2, 3, "item_id", 0.5).select("item_id", "wer", "selection"))


def q_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four examples of each language, evenly over the error rates."""
    return rounded(selection.spread_examples(conversation_scores(spark, sf_dir), "cer", "language", "item_id").select("language", "item_id", "cer"))


def q_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 120 conversations, evenly over the error rates."""
    return rounded(selection.thinned(conversation_scores(spark, sf_dir).select("item_id", "wer"), [F.desc("wer"), "item_id"], 120))


def q_fold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of languages' mean rates."""
    by = conversation_scores(spark, sf_dir).groupBy("language").agg(F.avg("wer").alias("f1"))
    return rounded(scoring.fold_spread(by, "f1"))


QUERIES = {
    f.__name__: f
    for f in (
        q_weighted_rates, q_shares, q_percentiles, q_histogram, q_correlations, q_quartiles, q_ratio_modes, q_error_slices, q_segmentation, q_segment_languages, q_top_quarter, q_trend, q_cdf, q_manifest_stats, q_language_means, q_drop_reasons,
        q_duration_budget, q_folds, q_segment_ids, q_resume, q_exclusion, q_first_wins, q_last_wins, q_worst, q_nearest, q_spread, q_thinned, q_fold_spread,
    )
}

_TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS item, CAST(turn AS DOUBLE) AS a, turn + length(coalesce(text, '')) / 100.0 AS b, CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'zh' ELSE 'unknown' END AS l FROM conversations WHERE conv_id IS NOT NULL)"""

SQL = {
    "q_weighted_rates": f"""
WITH {SCORES_SQL} SELECT source AS run, count(*) AS num_splits, count(*) AS num_conversations, round(sum(wer * ref_word_tokens) / sum(ref_word_tokens), 6) AS weighted_wer, round(sum(cer * hyp_word_tokens) / sum(hyp_word_tokens), 6) AS weighted_cer,
  round(sum(wer / 10 * duration_sec) / sum(duration_sec), 6) AS weighted_rtf, CAST(sum(tag_fil) AS BIGINT) AS segments_total, round(sum(duration_sec) / 3600, 6) AS audio_hours_total FROM scores GROUP BY source""",
    "q_shares": f"WITH {SCORES_SQL}, t AS (SELECT source, language, CAST(sum(ref_word_tokens) AS BIGINT) AS tokens FROM scores GROUP BY source, language) SELECT source, language, tokens, round(100.0 * tokens / sum(tokens) OVER (PARTITION BY source), 6) AS token_share_pct FROM t",
    "q_percentiles": f"WITH {SCORES_SQL} SELECT count(wer) AS n, round(avg(wer), 6) AS mean, round(median(wer), 6) AS median, round(quantile_cont(wer, 0.10), 6) AS p10, round(quantile_cont(wer, 0.25), 6) AS p25, round(quantile_cont(wer, 0.75), 6) AS p75, round(quantile_cont(wer, 0.90), 6) AS p90, round(min(wer), 6) AS min, round(max(wer), 6) AS max FROM scores",
    "q_histogram": f"""
WITH {SCORES_SQL}, b AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS bin)
SELECT bin, '[' || printf('%.1f', bin * 0.2) || ', ' || printf('%.1f', (bin + 1) * 0.2) || CASE WHEN bin = 4 THEN ']' ELSE ')' END AS label,
  (SELECT count(*) FROM scores WHERE wer >= [0.0, 0.2, 0.4, 0.6, 0.8][bin + 1] AND (wer < [0.2, 0.4, 0.6, 0.8, 1.0][bin + 1] OR (bin = 4 AND wer = 1.0))) AS n FROM b""",
    "q_correlations": f"""
WITH {SCORES_SQL} SELECT 'duration_sec' AS feature, round(corr(duration_sec, wer), 6) AS corr_with_wer, round(corr(duration_sec, cer), 6) AS corr_with_cer FROM scores
UNION ALL SELECT 'ratio', round(corr(hyp_word_tokens / CAST(ref_word_tokens AS DOUBLE), wer), 6), round(corr(hyp_word_tokens / CAST(ref_word_tokens AS DOUBLE), cer), 6) FROM scores UNION ALL SELECT 'flat', NULL, NULL""",
    "q_quartiles": f"""
WITH {SCORES_SQL}, q AS (SELECT quantile_cont(duration_sec, 0.25) AS a, quantile_cont(duration_sec, 0.5) AS b, quantile_cont(duration_sec, 0.75) AS c FROM scores),
m AS (SELECT s.*, CASE WHEN duration_sec <= a THEN 'Q1' WHEN duration_sec <= b THEN 'Q2' WHEN duration_sec <= c THEN 'Q3' ELSE 'Q4' END AS bucket FROM scores s, q)
SELECT bucket, count(*) AS n, round(avg(duration_sec), 6) AS mean_duration_sec, round(avg(wer), 6) AS mean_wer, round(median(wer), 6) AS median_wer, round(avg(cer), 6) AS mean_cer, round(median(cer), 6) AS median_cer FROM m GROUP BY bucket""",
    "q_ratio_modes": f"""
WITH {SCORES_SQL}, r AS (SELECT *, hyp_word_tokens / CAST(greatest(1, ref_word_tokens) AS DOUBLE) AS ratio FROM scores), m AS (SELECT *, CASE WHEN ratio < 0.75 THEN 'under_generate_lt_0.75' WHEN ratio <= 1.25 THEN 'balanced_0.75_to_1.25' ELSE 'over_generate_gt_1.25' END AS ratio_mode FROM r)
SELECT ratio_mode, count(*) AS n, round(avg(ratio), 6) AS mean_ratio, round(avg(wer), 6) AS mean_wer, round(avg(cer), 6) AS mean_cer, round(100.0 * count(*) / (SELECT count(*) FROM m), 6) AS share_pct FROM m GROUP BY ratio_mode""",
    "q_error_slices": f"""
WITH {SCORES_SQL}, x AS (
  SELECT wer, cer, unnest([CASE WHEN wer <= 0.2 THEN 'very_good_wer_le_0_20' WHEN wer <= 0.4 THEN 'good_0_20_to_0_40' WHEN wer <= 0.8 THEN 'moderate_0_40_to_0_80' ELSE 'severe_wer_gt_0_80' END, CASE WHEN cer > 1 THEN 'cer_gt_1_0' END]) AS slice FROM scores),
n AS (SELECT unnest(['very_good_wer_le_0_20', 'good_0_20_to_0_40', 'moderate_0_40_to_0_80', 'severe_wer_gt_0_80', 'cer_gt_1_0']) AS slice)
SELECT n.slice, count(x.wer) AS n, round(100.0 * count(x.wer) / (SELECT count(*) FROM scores), 6) AS share_pct, round(avg(x.wer), 6) AS mean_wer, round(avg(x.cer), 6) AS mean_cer FROM n LEFT JOIN x ON x.slice = n.slice GROUP BY n.slice""",
    "q_segmentation": f"""
WITH {SCORES_SQL}, {_TURNS}, g AS (SELECT item, count(*) AS n, sum(greatest(0, b - a)) AS s FROM turns GROUP BY item)
SELECT item_id, round(wer, 6) AS wer, round(cer, 6) AS cer, round(greatest(1, duration_sec), 6) AS duration_sec, coalesce(n, 0) AS segments, round(coalesce(n, 0) / (greatest(1, duration_sec) / 60), 6) AS segments_per_min, round(coalesce(s, 0) / greatest(1, coalesce(n, 0)), 6) AS avg_segment_sec, round(coalesce(s, 0) / greatest(1, duration_sec), 6) AS seg_audio_coverage_ratio
FROM scores LEFT JOIN g ON g.item = item_id""",
    "q_segment_languages": f"""
WITH {SCORES_SQL}, {_TURNS}, g AS (SELECT item, count(*) AS n, count(*) FILTER (l = 'en') AS en, count(*) FILTER (l = 'zh') AS zh, count(*) FILTER (l = 'unknown') AS un FROM turns GROUP BY item),
c AS (SELECT item_id, coalesce(n, 0) AS n, coalesce(en, 0) AS en, coalesce(zh, 0) AS zh, coalesce(un, 0) AS un FROM scores LEFT JOIN g ON g.item = item_id)
SELECT item_id, n AS segment_count, CASE WHEN en >= zh AND en >= un THEN 'en' WHEN zh >= un THEN 'zh' WHEN un = 0 THEN 'mixed' ELSE 'unknown' END AS dominant_seg_lang, round(en / CAST(greatest(1, n) AS DOUBLE), 6) AS en_seg_share, round(zh / CAST(greatest(1, n) AS DOUBLE), 6) AS zh_seg_share, CAST(0 AS DOUBLE) AS mixed_seg_share, round(un / CAST(greatest(1, n) AS DOUBLE), 6) AS unknown_seg_share FROM c""",
    "q_top_quarter": f"WITH {SCORES_SQL}, q AS (SELECT quantile_cont(tag_fil, 0.75) AS c FROM scores) SELECT CASE WHEN tag_fil >= c THEN 'high_top_quartile' ELSE 'low_bottom_3_quartiles' END AS slice, count(*) AS n, round(avg(wer), 6) AS mean_wer, round(avg(cer), 6) AS mean_cer FROM scores, q GROUP BY 1",
    "q_trend": f"WITH {SCORES_SQL} SELECT language, count(*) AS n, round(CASE WHEN count(*) > 3 THEN regr_slope(least(wer, 100), duration_sec) END, 6) AS slope, round(CASE WHEN count(*) > 3 THEN regr_intercept(least(wer, 100), duration_sec) END, 6) AS intercept FROM scores GROUP BY language",
    "q_cdf": f"WITH {SCORES_SQL} SELECT DISTINCT language, round(wer, 6) AS wer, round(cume_dist() OVER (PARTITION BY language ORDER BY wer), 6) AS cdf FROM scores",
    "q_manifest_stats": "SELECT count(*) AS items, round(sum(n_chars / 15.0), 4) AS total_sec, round(avg(n_chars / 15.0), 4) AS mean_sec, round(min(n_chars / 15.0), 4) AS min_sec, round(max(n_chars / 15.0), 4) AS max_sec, round(avg(length(coalesce(text, ''))), 4) AS mean_chars, CAST(min(length(coalesce(text, ''))) AS INTEGER) AS min_chars, CAST(max(length(coalesce(text, ''))) AS INTEGER) AS max_chars FROM documents",
    "q_language_means": f"WITH {SCORES_SQL} SELECT language, round(avg(wer), 2) AS wer, round(avg(cer), 2) AS cer FROM scores GROUP BY language",
    "q_drop_reasons": "SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(trim(text)) > 500 THEN 'long_chars' WHEN n_chars / 15.0 > 30 THEN 'long_audio' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "q_duration_budget": """
WITH h AS (SELECT doc_id, n_chars / 15.0 AS duration_sec, md5('42|' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, duration_sec, row_number() OVER w AS rank, coalesce(sum(duration_sec) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec_before FROM h WINDOW w AS (ORDER BY h, doc_id))
SELECT doc_id, round(duration_sec, 4) AS duration_sec, rank, round(sec_before, 4) AS sec_before FROM r WHERE sec_before < 60000 AND rank <= 300""",
    "q_folds": "SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents",
    "q_segment_ids": "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL) SELECT conv_id, turn, 'seg_' || lpad(CAST(99 + row_number() OVER (ORDER BY conv_id, turn NULLS FIRST) AS VARCHAR), 6, '0') AS segment_id FROM t",
    "q_resume": "SELECT lang, count(*) AS n, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 'done' ELSE 'todo' END AS state FROM documents GROUP BY 1, 3",
    "q_exclusion": "SELECT CAST(doc_id AS VARCHAR) AS utt_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT page_id FROM pages WHERE page_id IS NOT NULL)",
    "q_first_wins": "SELECT user_id || '-' || event_type AS segment_id, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY 1",
    "q_last_wins": "SELECT user_id || '-' || event_type AS segment_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1",
    "q_worst": f"WITH {SCORES_SQL} SELECT item_id, round(wer, 6) AS wer FROM scores ORDER BY scores.wer DESC, ref_word_tokens DESC, item_id LIMIT 10",
    "q_nearest": f"WITH {SCORES_SQL} SELECT item_id, round(wer, 6) AS wer, 'band' AS selection FROM scores WHERE scores.wer BETWEEN 0 AND 0.2 ORDER BY abs(scores.wer - 0.1), item_id LIMIT 3",
    "q_spread": f"""
WITH {SCORES_SQL}, r AS (SELECT language, item_id, cer, row_number() OVER (PARTITION BY language ORDER BY cer, item_id) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM scores)
SELECT language, item_id, round(cer, 6) AS cer FROM r WHERE i IN (0, n // 3, 2 * n // 3, n - 1)""",
    "q_thinned": f"WITH {SCORES_SQL}, r AS (SELECT item_id, wer, row_number() OVER (ORDER BY wer DESC, item_id) - 1 AS i, count(*) OVER () AS n FROM scores) SELECT item_id, round(wer, 6) AS wer FROM r WHERE i % greatest(1, n // 120) = 0",
    "q_fold_spread": f"WITH {SCORES_SQL}, b AS (SELECT language, avg(wer) AS f1 FROM scores GROUP BY language) SELECT round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std FROM b",
}
