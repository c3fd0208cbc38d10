"""Choosing rows: samples by duration, folds, resumption, exclusion, and examples.

Random orders are those of an MD5 of seed and id: the same on any cluster and in any SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscribe.functions.text import utterance_of_item
from veilscribe.shared import checkpointed


def shuffled_by(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def duration_budget(rows: DataFrame, *, target_sec: float, most_items: int, key: str, duration: str = "duration_sec", seed: int = 42) -> DataFrame:
    """Rows in random order until their durations reach the target, the one that reaches it included, or there are enough; with rank and seconds before.

    The running sum goes over ranges of the first 16 bits of the hash: the budget's range
    is found from their sums, and only rows up to it are sorted.
    """
    hashed = rows.withColumn("__h", shuffled_by(seed, key)).withColumn("__d", F.coalesce(F.col(duration).cast("double"), F.lit(0.0)))
    head = F.substring("__h", 1, 4)
    sums = hashed.groupBy(head.alias("__head")).agg(F.sum("__d").alias("__sec"), F.count("*").alias("__n"))
    # at most 65,536 rows
    order = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumns({"__sec0": F.coalesce(F.sum("__sec").over(order), F.lit(0.0)), "__n0": F.coalesce(F.sum("__n").over(order), F.lit(0))})
    needed = before.filter((F.col("__sec0") < target_sec) & (F.col("__n0") < most_items)).select("__head", "__sec0", "__n0")
    kept = hashed.join(F.broadcast(needed), head == F.col("__head"))
    within = Window.partitionBy("__head").orderBy("__h", key)
    kept = kept.withColumns({"sec_before": F.col("__sec0") + F.coalesce(F.sum("__d").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rank": F.col("__n0") + F.row_number().over(within)})
    return kept.filter((F.col("sec_before") < target_sec) & (F.col("rank") <= most_items)).select(*rows.columns, "rank", "sec_before")


def numbered(rows: DataFrame, order: list, out: str, *, start: int = 0) -> DataFrame:
    """Rows with consecutive numbers in a total order, without bringing them together.

    Rows are sorted by ranges and written to the checkpoint folder, which fixes the
    ranges whatever executors are lost.  A row for each range then gives its first number.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    ranged = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    firsts = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    return ranged.join(F.broadcast(firsts), F.col("__part") == F.col("__p")).withColumn(out, (F.col("__first") + F.col("__at") + start).cast("long")).select(*rows.columns, out)


def running(rows: DataFrame, order: list, amount: str, out: str) -> DataFrame:
    """Rows with the sum of ``amount`` over those before in a total order, without bringing them together; as ``numbered`` does it."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return placed.join(F.broadcast(firsts), F.col("__part") == F.col("__p")).withColumn(out, F.col("__first") + F.col("__inner")).select(*rows.columns, out)


def folds(rows: DataFrame, k: int, *, key: str, seed: int = 42) -> DataFrame:
    """Rows dealt to k folds in turn, in random order; column fold."""
    hashed = rows.withColumn("__h", shuffled_by(seed, key))
    return numbered(hashed, ["__h", key], "__n").withColumn("fold", F.pmod("__n", F.lit(k)).cast("int")).drop("__n", "__h")


def fold_split(dealt: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold."""
    return dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)


def segment_ids(rows: DataFrame, order: list[str], *, last: int = -1) -> DataFrame:
    """Rows with segment_id seg_000000 and on, after the last number that is taken."""
    return numbered(rows, order, "__n", start=last + 1).withColumn("segment_id", F.format_string("seg_%06d", F.col("__n"))).drop("__n")


def last_segment_number(segments: DataFrame) -> Column:
    return F.max(F.regexp_extract("segment_id", r"^seg_(\d+)$", 1).try_cast("long"))


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "item_id", done_key: str = "source_item_id") -> DataFrame:
    """Inputs whose id is not among the rows that are there."""
    seen = done.select(F.col(done_key).cast("string").alias(key)).filter(f"`{key}` IS NOT NULL AND `{key}` != ''").distinct()
    return inputs.join(seen, key, "left_anti")


def already_processed(inputs: DataFrame, done: DataFrame, key: str = "item_id", done_key: str = "source_item_id") -> DataFrame:
    return inputs.join(done.select(F.col(done_key).cast("string").alias(key)).distinct(), key, "left_semi")


def without(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in any row of ``excluded``; rows without a key stay."""
    return rows.join(excluded.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def excluded_ids(manifest: DataFrame | None, ids: DataFrame | None, key: str = "utt_id") -> DataFrame:
    """Distinct ids of a manifest (its utt_id, else the third part of item_id) and of a table of ids."""
    parts = []
    if manifest is not None:
        parts.append(manifest.select(F.coalesce(F.nullif(F.col(key), F.lit("")), utterance_of_item("item_id")).alias(key)))
    if ids is not None:
        parts.append(ids.select(F.trim(key).alias(key)))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.filter(f"`{key}` IS NOT NULL AND `{key}` != ''").distinct()


def in_file_order(rows: DataFrame, n: int, pos: str = "_pos") -> DataFrame:
    """The first n rows of a file; n of 0 or less means all."""
    return rows.orderBy(pos).limit(n) if n > 0 else rows


def worst(rows: DataFrame, metric: str, n: int, then: list, *, ascending: bool = False) -> DataFrame:
    """The n rows with the greatest (or smallest) metric; ``then`` breaks ties."""
    return rows.orderBy(F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric), *then).limit(n)


def nearest(rows: DataFrame, metric: str, low: float, high: float, n: int, key: str, fallback: float) -> DataFrame:
    """The n rows of a band that are nearest to its middle; of all rows nearest to ``fallback`` if fewer than three lie in the band."""
    inside = F.col(metric).between(low, high)
    enough = rows.agg((F.count_if(inside) >= 3).alias("__enough"))
    marked = rows.crossJoin(F.broadcast(enough))  # one row
    distance = F.when(F.col("__enough"), F.abs(F.col(metric) - (low + high) / 2)).otherwise(F.abs(F.col(metric) - fallback))
    kept = marked.filter(~F.col("__enough") | inside).withColumn("selection", F.when(F.col("__enough"), "band").otherwise("fallback_near_median"))
    return kept.withColumn("__d", distance).orderBy("__d", key).limit(n).drop("__d", "__enough")


def spread_examples(rows: DataFrame, metric: str, by: str, key: str) -> DataFrame:
    """Of each group the best, the worst and the two at a third and two thirds of the way.

    Ranks come from one numbering of all rows by group, so that a large group is no task's alone.
    """
    ranked = checkpointed(numbered(rows, [by, metric, key], "__n"))
    groups = ranked.groupBy(F.col(by).alias("__by")).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    both = ranked.join(groups, F.col(by).eqNullSafe(F.col("__by")))
    at, n = F.col("__n") - F.col("__first"), F.col("__size")
    return both.filter((at == 0) | (at == F.floor(n / 3)) | (at == F.floor(2 * n / 3)) | (at == n - 1)).select(*rows.columns)


def thinned(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Every k-th row in order, so that about ``most`` are left; all if there are no more."""
    total = rows.agg(F.count("*").alias("__total"))
    step = F.greatest(F.lit(1), F.floor(F.col("__total") / most))
    return numbered(rows, order, "__n").crossJoin(F.broadcast(total)).filter(F.col("__n") % step == 0).drop("__n", "__total")
