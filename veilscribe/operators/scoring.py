"""Precision, recall and their means: by greedy span matching and by strict BIO entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscribe.functions import labels
from veilscribe.functions.matches import no_spans
from veilscribe.functions.spans import first_hit_pairs, greedy_pairs

_NO_ENTITIES = "cast(array() as array<struct<pii_type: string, text: string, start_char: int, end_char: int>>)"


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, beta: float = 2.0, digits: int | None = None) -> dict[str, Column]:
    """precision, recall, f1 and fbeta; 0 where undefined, rounded to ``digits`` if given."""
    p, r, b2 = _share(tp, tp + fp), _share(tp, tp + fn), beta * beta
    out = {"precision": p, "recall": r, "f1": _share(2 * p * r, p + r), "fbeta": _share((1 + b2) * p * r, b2 * p + r)}
    return out if digits is None else {k: F.round(v, digits) for k, v in out.items()}


def with_prf(counts: DataFrame, beta: float = 2.0, digits: int | None = None) -> DataFrame:
    """Rows with tp, fp, fn, and with support and the scores added."""
    found = prf(F.col("tp"), F.col("fp"), F.col("fn"), beta, digits)
    return counts.withColumns({"support": F.col("tp") + F.col("fn"), **found})


# ------------------------------------------------------------------------- overlap scoring


def last_wins(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row for each key: the last by ``pos``.  A map-side aggregation, not a window, so a hot key is no matter."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(pos)).alias("__row")).select(key, *(F.col("__row")[c].alias(c) for c in others))


def match_records(predictions: DataFrame, gold: DataFrame, *, threshold: float = 0.5, first_hit: bool = False, pos: str | None = None) -> DataFrame:
    """record_id, language, transcript, tp_pairs, fps, fns of the records that have both predictions and gold.

    Gold records without predictions do not count.  Of gold rows with one id the last by
    ``pos`` wins, if that is given.  ``first_hit`` takes the simpler matching, in which
    gold without offsets is ignored.
    """
    g = last_wins(gold.select("record_id", "language", "transcript", "entities", *([pos] if pos else [])), "record_id", pos) if pos else gold
    g = g.select("record_id", F.coalesce("language", F.lit("unknown")).alias("language"), "transcript", F.coalesce("entities", F.expr(_NO_ENTITIES)).alias("gold"))
    p = predictions.select("record_id", F.coalesce("spans", no_spans()).alias("predicted"))
    both = p.join(g, "record_id")
    pairs = (first_hit_pairs if first_hit else greedy_pairs)(F.col("gold"), F.col("predicted"), threshold)
    both = both.withColumn("pairs", pairs)
    missed = F.filter("gold", lambda e, i: ~F.exists(F.col("pairs"), lambda x: x["gi"] == i))
    if first_hit:
        missed = F.filter(missed, lambda e: e["start_char"].isNotNull())
    return both.select(
        "record_id", "language", "transcript", "gold", "predicted",
        F.transform("pairs", lambda x: F.struct(F.get(F.col("gold"), x["gi"]).alias("gold"), F.get(F.col("predicted"), x["pi"]).alias("pred"), x["overlap"].alias("overlap"))).alias("tp_pairs"),
        F.filter("predicted", lambda s, i: ~F.exists(F.col("pairs"), lambda x: x["pi"] == i)).alias("fps"),
        missed.alias("fns"),
    )


def record_scores(matched: DataFrame, beta: float = 2.0) -> DataFrame:
    counts = matched.select("record_id", "language", F.size("tp_pairs").alias("tp"), F.size("fps").alias("fp"), F.size("fns").alias("fn"), F.size("gold").alias("gold_count"), F.size("predicted").alias("pred_count"))
    return with_prf(counts, beta, 4).drop("support")


def record_errors(matched: DataFrame) -> DataFrame:
    """Records with a false positive or negative, and which these are."""
    wrong = matched.filter((F.size("fps") > 0) | (F.size("fns") > 0))
    return wrong.select(
        "record_id", "language", F.substring("transcript", 1, 200).alias("transcript_preview"),
        F.transform("fps", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), s["source"].alias("source"))).alias("false_positives"),
        F.transform("fns", lambda e: F.struct(e["pii_type"].alias("type"), e["text"].alias("text"))).alias("false_negatives"),
    )


def outcomes(matched: DataFrame) -> DataFrame:
    """language, type, tp, fp, fn: a row for each outcome; hits and misses have the gold type, false alarms the predicted one."""
    kind = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    row = lambda k, tp, fp, fn: F.struct(kind(k).alias("type"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    every = F.concat(F.transform("tp_pairs", lambda x: row(x["gold"]["pii_type"], 1, 0, 0)), F.transform("fps", lambda s: row(s["type"], 0, 1, 0)), F.transform("fns", lambda e: row(e["pii_type"], 0, 0, 1)))
    return matched.select("language", F.inline(every))


def scores_by(counts: DataFrame, *scopes: str, beta: float = 2.0, digits: int | None = None) -> DataFrame:
    """tp, fp, fn summed over all rows and by each of ``scopes`` at once: columns scope and value, and the scores.

    One expansion and one aggregation with partial sums, whatever the number of scopes.
    """
    names = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("ALL").alias("value")), *(F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("value")) for s in scopes))
    summed = counts.select(F.inline(names), "tp", "fp", "fn").groupBy("scope", "value").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return with_prf(summed, beta, digits)


def texts_by_type(errors: DataFrame, column: str, most: int = 5) -> DataFrame:
    """type, texts: up to ``most`` texts of false positives or negatives of each type, by record and place."""
    rows = errors.select("record_id", F.posexplode(column).alias("at", "e")).select("record_id", "at", F.coalesce("e.type", F.lit("UNKNOWN")).alias("type"), "e.text")
    n = F.row_number().over(Window.partitionBy("type").orderBy("record_id", "at"))
    few = rows.withColumn("n", n).filter(F.col("n") <= most)  # Spark limits each group before the shuffle
    return few.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"))


# ----------------------------------------------------------------------- strict BIO scoring


def bio_items(sentences: DataFrame, allowed: list[str], *, spans_col: str | None = None, tags_col: str | None = None) -> DataFrame:
    """Sentences with gold and predicted entities: predictions are spans over the joined tokens, or tags.

    Sentences without tokens are left out; gold tags are fitted to the tokens.
    """
    joined = labels.joined_tokens(F.col("tokens"))
    out = sentences.filter(F.size("tokens") > 0).withColumn("gold_fitted", labels.normal_tags(labels.fitted_tags(F.col("gold_tag_names"), F.col("tokens")), allowed))
    predicted = labels.tags_from_spans(F.col(spans_col), joined["offsets"], allowed) if spans_col else labels.normal_tags(labels.fitted_tags(F.col(tags_col), F.col("tokens")), allowed)
    out = out.withColumn("predicted_tags", predicted)
    return out.withColumns({"gold_set": labels.entities(F.col("gold_fitted")), "predicted_set": labels.entities(F.col("predicted_tags")), "token_count": F.size("tokens"), "token_correct": labels.agreeing(F.col("gold_fitted"), F.col("predicted_tags"))})


def bio_scores(items: DataFrame) -> DataFrame:
    """split, item_id, lang, token counts, and the numbers of gold, predicted, right and wrong entities of each sentence."""
    c = labels.entity_counts(F.col("gold_set"), F.col("predicted_set"))
    return items.withColumn("__c", c).select(
        "split", "item_id", "lang", "token_count", "token_correct", F.size("gold_set").alias("gold_entities"), F.size("predicted_set").alias("pred_entities"),
        F.size("__c.tp").alias("tp"), F.size("__c.fp").alias("fp"), F.size("__c.fn").alias("fn"),
    )


def bio_outcomes(items: DataFrame) -> DataFrame:
    """split, type, tp, fp, fn: a row for each entity that is right or wrong."""
    c = labels.entity_counts(F.col("gold_set"), F.col("predicted_set"))
    row = lambda tp, fp, fn: lambda e: F.struct(e["type"].alias("type"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    # before a plain inline Spark filters by the array's size, which finds all entities twice
    return items.withColumn("__c", c).select("split", F.inline_outer(F.concat(F.transform("__c.tp", row(1, 0, 0)), F.transform("__c.fp", row(0, 1, 0)), F.transform("__c.fn", row(0, 0, 1))))).filter("tp IS NOT NULL")


def bio_summary(scores: DataFrame, beta: float = 1.0) -> DataFrame:
    """By split, and for ALL: sentences, token accuracy, counts and scores."""
    scopes = F.explode(F.array(F.coalesce("split", F.lit("unknown")), F.lit("ALL")))
    sums = [F.sum(c).cast("long").alias(c) for c in ("token_count", "token_correct", "tp", "fp", "fn")]
    out = scores.withColumn("split", scopes).groupBy("split").agg(F.count("*").alias("num_sentences"), *sums)
    return with_prf(out.withColumn("token_accuracy", _share(F.col("token_correct"), F.col("token_count"))), beta)


def type_scores(outcome_rows: DataFrame, beta: float = 1.0) -> DataFrame:
    """By split and type: counts, support and scores."""
    return with_prf(outcome_rows.groupBy("split", "type").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn"))), beta)


def averaged(by_type: DataFrame) -> DataFrame:
    """By split: macro and support-weighted means of f1 and fbeta."""
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return by_type.groupBy("split").agg(F.avg("f1").alias("macro_f1"), F.avg("fbeta").alias("macro_fbeta"), weighted("f1").alias("weighted_f1"), weighted("fbeta").alias("weighted_fbeta"), F.sum("support").alias("entity_support"))


def error_profile(scores: DataFrame) -> DataFrame:
    """By split: how many sentences have predictions, miss all entities, or are perfect, and ratios of errors to hits."""
    n = F.count("*")
    rows = scores.groupBy(F.coalesce("split", F.lit("unknown")).alias("split")).agg(
        n.alias("sentences"),
        (F.count_if(F.col("pred_entities") > 0) / n).alias("predicted_any_rate"),
        F.coalesce(F.try_divide(F.count_if((F.col("gold_entities") > 0) & (F.col("pred_entities") == 0)).cast("double"), F.count_if(F.col("gold_entities") > 0)), F.lit(0.0)).alias("missed_all_rate_given_gold"),
        (F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)) / n).alias("sentence_perfect_rate"),
        *(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")),
    )
    return rows.withColumns({"fn_to_tp_ratio": F.try_divide(F.col("fn").cast("double"), F.col("tp")), "fp_to_tp_ratio": F.try_divide(F.col("fp").cast("double"), F.col("tp"))})


def label_distribution(sentences: DataFrame) -> DataFrame:
    """split, tag, n over all tags of all sentences."""
    return sentences.select("split", F.explode("gold_tag_names").alias("tag")).groupBy("split", "tag").agg(F.count("*").alias("n"))


def annotation_stats(gold: DataFrame) -> DataFrame:
    """By split and language: records, entities, and entities with and without offsets."""
    has = F.size(F.filter("entities", lambda e: e["start_char"].isNotNull() & e["end_char"].isNotNull()))
    n = F.greatest(F.size(F.coalesce("entities", F.expr(_NO_ENTITIES))), F.lit(0))
    return gold.groupBy("split", "language").agg(F.count("*").alias("records"), F.sum(n).cast("long").alias("entities"), F.sum(F.greatest(has, F.lit(0))).cast("long").alias("with_offsets"))


def fold_spread(folds: DataFrame, *metrics: str) -> DataFrame:
    """Mean and sample standard deviation of metrics over folds."""
    return folds.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
