"""Tables of quality diagnostics: weighted means, shares, percentiles, histograms, slices and trends.

Percentiles are exact: values are counted, and the counts of smaller ones are summed over
ranges of them, so that no task holds all values.  A one-row table of quartiles joins
the rows as a broadcast of known size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscribe.operators.selection import running


def weighted(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_rates(splits: DataFrame, by: str = "run") -> DataFrame:
    """Per run: error rates weighted by tokens and characters, real-time factor by audio, and totals."""
    return splits.groupBy(by).agg(
        F.count("*").alias("num_splits"), F.sum("num_conversations").alias("num_conversations"), weighted(F.col("wer"), F.col("ref_word_tokens")).alias("weighted_wer"), weighted(F.col("cer"), F.col("ref_chars")).alias("weighted_cer"),
        weighted(F.col("rtf"), F.col("total_audio_sec")).alias("weighted_rtf"), F.sum("segments").alias("segments_total"), (F.sum("total_audio_sec") / 3600.0).alias("audio_hours_total"),
    )


def share_pct(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Each row's per cent of its group's sum, the sum counting as 1 at least.  Groups are of summary rows."""
    total = F.sum(value).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return rows.withColumn(out, 100.0 * F.col(value) / F.greatest(F.lit(1.0), total.cast("double")))


def percentiles(rows: DataFrame, column: str, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, __q: the exact percentiles of the values that are there, interpolated between neighbours; nulls where there are none.

    Without ``by`` one row.
    """
    groups = [F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]
    names = [f"__g{k}" for k in range(len(by))]
    counted = rows.filter(F.col(column).isNotNull()).groupBy(*groups, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = running(counted, [*names, "__v"], "__n", "__before")
    sizes = placed.groupBy(*(F.col(n).alias(f"{n}s") for n in names)).agg(F.sum("__n").alias("__all"), F.min("__before").alias("__base"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    placed = placed.join(sizes, same) if names else placed.crossJoin(F.broadcast(sizes))
    at = F.col("__before") - F.col("__base")
    place = lambda p: F.lit(p) * (F.col("__all") - 1)
    here = lambda k: (k >= at) & (k < at + F.col("__n"))
    marked = placed.filter(F.coalesce(F.array_max(F.array(*(here(f(place(p))) for p in points for f in (F.floor, F.ceil)))), F.lit(False)))
    value = lambda k: F.max(F.when(here(k), F.col("__v")))
    found = marked.groupBy(*names).agg(*(value(f(place(p))).alias(f"__{i}{n}") for i, p in enumerate(points) for n, f in (("a", F.floor), ("b", F.ceil))), F.max("__all").alias("__all"))

    def between(i, p):
        low, high, k = F.col(f"__{i}a"), F.col(f"__{i}b"), place(p)
        return F.when(low == high, low).otherwise((F.ceil(k) - k) * low + (k - F.floor(k)) * high)

    return found.select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), F.array(*(between(i, p) for i, p in enumerate(points))).alias("__q"))


def distribution(rows: DataFrame, column: str, points: tuple[float, ...] = (0.10, 0.25, 0.75, 0.90)) -> DataFrame:
    """n, mean, median, exact interpolated percentiles, least and greatest of the values that are there."""
    c = F.col(column)
    one = rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")).crossJoin(F.broadcast(percentiles(rows, column, (0.5, *points))))
    return one.select("n", "mean", F.col("__q")[0].alias("median"), *(F.col("__q")[k + 1].alias(f"p{round(100 * p)}") for k, p in enumerate(points)), "min", "max")


def histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin, label, n of every bin, empty ones too; the last is closed, and values outside are dropped."""
    c, last = F.col(column), len(edges) - 2
    number = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        number = F.when((c >= edges[i]) & ((c <= edges[i + 1]) if i == last else (c < edges[i + 1])), i).otherwise(number)
    counts = [F.count_if(F.col("__bin") == i).alias(f"n{i}") for i in range(last + 1)]
    names = [f"[{edges[i]:.1f}, {edges[i + 1]:.1f}{']' if i == last else ')'}" for i in range(last + 1)]
    bins = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(names[i]).alias("label"), F.col(f"n{i}").alias("n")) for i in range(last + 1)))
    return rows.select(number.alias("__bin")).agg(*counts).select(F.inline(bins))


def correlation(x: str, y: str) -> Column:
    """Pearson over the rows that have both; null where either does not vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """feature, corr_with_<target>...: all of them in one pass."""
    names = [(f, t) for f in features for t in targets]
    one = rows.agg(*(correlation(f, t).alias(f"{f}__{t}") for f, t in names))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"{f}__{t}").alias(f"corr_with_{t}") for t in targets)) for f in features))))


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    return percentiles(rows, column, (0.25, 0.5, 0.75))


def with_quartile(rows: DataFrame, column: str, labels: tuple[str, str, str, str], out: str = "bucket") -> DataFrame:
    """Rows with the label of their quarter; ties fall to the lower one."""
    c, q = F.col(column), F.col("__q")
    bucket = F.when(c <= q[0], labels[0]).when(c <= q[1], labels[1]).when(c <= q[2], labels[2]).otherwise(labels[3])
    # one row of three numbers
    return rows.crossJoin(F.broadcast(quartiles(rows, column))).withColumn(out, bucket).drop("__q")


def by_quartile(rows: DataFrame, column: str, labels: tuple[str, str, str, str], values: list[str]) -> DataFrame:
    """bucket, n, mean_<column>, and mean and median of the values."""
    marked = with_quartile(rows, column, labels)
    out = marked.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(column).alias(f"mean_{column}"), *(F.avg(v).alias(f"mean_{v}") for v in values))
    for v in values:
        # at most a row for each bucket
        middle = percentiles(marked, v, (0.5,), ("bucket",)).select(F.col("bucket").alias("__b"), F.col("__q")[0].alias(f"median_{v}"))
        out = out.join(F.broadcast(middle), F.col("bucket").eqNullSafe(F.col("__b")), "left").drop("__b")
    return out.select("bucket", "n", f"mean_{column}", *(f"{k}_{v}" for v in values for k in ("mean", "median")))


def top_quarter(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows at or above the third quartile against the rest."""
    marked = rows.crossJoin(F.broadcast(quartiles(rows, column))).withColumn("slice", F.when(F.col(column) >= F.col("__q")[2], "high_top_quartile").otherwise("low_bottom_3_quartiles"))
    return marked.groupBy("slice").agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def grouped_summary(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """by, n, share_pct of all rows, and means of the values."""
    return share_pct(rows.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values)), "n", [], "share_pct")


def overlapping_slices(rows: DataFrame, slices: dict[str, Column], values: list[str]) -> DataFrame:
    """slice, n, share_pct and means, for every named condition; a row counts in each slice that it meets."""
    cols = []
    for i, cond in enumerate(slices.values()):
        cols += [F.count_if(cond).alias(f"n{i}"), *(F.avg(F.when(cond, F.col(v))).alias(f"m{i}_{v}") for v in values)]
    one = rows.agg(F.count("*").alias("__all"), *cols)
    made = [F.struct(F.lit(name).alias("slice"), F.col(f"n{i}").alias("n"), (100.0 * F.col(f"n{i}") / F.greatest(F.lit(1), F.col("__all"))).alias("share_pct"), *(F.col(f"m{i}_{v}").alias(f"mean_{v}") for v in values)) for i, name in enumerate(slices)]
    return one.select(F.inline(F.array(*made)))


def error_slices(rows: DataFrame) -> DataFrame:
    wer, cer = F.col("wer"), F.col("cer")
    return overlapping_slices(rows, {
        "very_good_wer_le_0_20": wer <= 0.20, "good_0_20_to_0_40": (wer > 0.20) & (wer <= 0.40), "moderate_0_40_to_0_80": (wer > 0.40) & (wer <= 0.80), "severe_wer_gt_0_80": wer > 0.80, "cer_gt_1_0": cer > 1.0,
    }, ["wer", "cer"])


def segmentation(scores: DataFrame, segments: DataFrame) -> DataFrame:
    """How the segments of each conversation cover it: number, by minute, mean length, share of its time.  Conversations without segments have 0."""
    long = F.greatest(F.lit(0.0), F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0)))
    each = segments.groupBy(F.col("source_item_id").cast("string").alias("item_id")).agg(F.count("*").alias("segments"), F.sum(long).alias("audio"))
    both = scores.join(each, "item_id", "left").withColumns({"segments": F.coalesce("segments", F.lit(0)), "audio": F.coalesce("audio", F.lit(0.0)), "duration_sec": F.greatest(F.lit(1.0), F.coalesce("duration_sec", F.lit(0.0)))})
    return both.select("item_id", "wer", "cer", "duration_sec", "segments", (F.col("segments") / (F.col("duration_sec") / 60.0)).alias("segments_per_min"), (F.col("audio") / F.greatest(F.lit(1), F.col("segments"))).alias("avg_segment_sec"), (F.col("audio") / F.col("duration_sec")).alias("seg_audio_coverage_ratio"))


def segmentation_summary(stability: DataFrame) -> DataFrame:
    """One row: means over conversations, the 90th percentile, and correlations with the error rate."""
    means = stability.agg(
        F.avg("segments_per_min").alias("mean_segments_per_min"), F.avg("avg_segment_sec").alias("mean_avg_segment_sec"), F.avg("seg_audio_coverage_ratio").alias("mean_seg_audio_coverage_ratio"),
        correlation("segments_per_min", "wer").alias("corr_segments_per_min_with_wer"), correlation("avg_segment_sec", "wer").alias("corr_avg_segment_sec_with_wer"),
    )
    return means.crossJoin(F.broadcast(percentiles(stability, "segments_per_min", (0.9,)))).withColumn("p90_segments_per_min", F.col("__q")[0]).drop("__q")


def segment_languages(scores: DataFrame, segments: DataFrame) -> DataFrame:
    """Each conversation's segments by language as shares, and the one with most; ties go to en, then zh, mixed, unknown."""
    kinds = ("en", "zh", "mixed", "unknown")
    code = F.lower(F.coalesce("language", F.lit("unknown")))
    known = F.when(code.isin(*kinds), code).otherwise("unknown")
    each = segments.groupBy(F.col("source_item_id").cast("string").alias("item_id")).agg(F.count("*").alias("total"), *(F.count_if(known == k).alias(f"__{k}") for k in kinds))
    both = scores.join(each, "item_id", "left").na.fill(0, ["total", *(f"__{k}" for k in kinds)])
    most = F.greatest(*(F.col(f"__{k}") for k in kinds))
    dominant = F.lit(kinds[-1])
    for k in reversed(kinds[:-1]):
        dominant = F.when(F.col(f"__{k}") == most, k).otherwise(dominant)
    shares = [(F.col(f"__{k}") / F.greatest(F.lit(1), F.col("total"))).alias(f"{k}_seg_share") for k in kinds]
    return both.select("item_id", "wer", "cer", "duration_sec", F.col("total").alias("segment_count"), dominant.alias("dominant_seg_lang"), *shares)


def trend(rows: DataFrame, x: str, y: str, by: list[str], top: float = 100.0) -> DataFrame:
    """Least squares of y, at most ``top``, on x: slope, intercept, n; null for three rows or fewer."""
    v = F.least(F.col(y), F.lit(top))
    enough = F.count("*") > 3
    # not regr_slope, which fails where x does not vary
    slope = F.try_divide(F.covar_pop(F.col(x), v), F.var_pop(F.when(v.isNotNull(), F.col(x))))
    means = F.avg(F.when(F.col(x).isNotNull(), v)), F.avg(F.when(v.isNotNull(), F.col(x)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(enough, slope).alias("slope"), F.when(enough, means[0] - slope * means[1]).alias("intercept"))


def cumulative(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The distribution function at each value of each group: value, share of rows up to it.

    Counts by value come first, so that the window sorts distinct values, not rows.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up_to = F.sum("n").over(part.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*by, column, (up_to / F.sum("n").over(part)).alias("cdf"))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """One row: items, and sum, mean, least and greatest of durations and of transcript lengths."""
    d, n = F.coalesce("duration_sec", F.lit(0.0)), F.length(F.coalesce("transcript", F.lit("")))
    return manifest.agg(F.count("*").alias("items"), F.sum(d).alias("total_sec"), F.avg(d).alias("mean_sec"), F.min(d).alias("min_sec"), F.max(d).alias("max_sec"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def mean_by_language(rows: DataFrame, *metrics: str) -> DataFrame:
    return rows.groupBy("language").agg(*(F.round(F.avg(m), 2).alias(m) for m in metrics))


def drop_reasons(records: DataFrame, *, most_chars: int = 500, most_sec: float = 30.0, duration: str = "duration_sec") -> DataFrame:
    """Records with why they are unfit for training (null: fit): empty, long_chars or long_audio, in this order."""
    text = F.trim(F.coalesce("transcript", F.lit("")))
    reason = F.when(text == "", "empty").when(F.length(text) > most_chars, "long_chars").when(F.col(duration) > most_sec, "long_audio")
    return records.withColumn("drop_reason", reason)
