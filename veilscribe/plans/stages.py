"""The stages as functions of a configuration: each reads its tables, writes its own, and returns its folder.

A configuration is the dictionary of a YAML file: ``run`` names the run and its inputs,
the rest is the stage's own.  ``root`` is where runs are kept.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscribe import schemas
from veilscribe.functions.text import LANGUAGE_ALIASES
from veilscribe.operators import masking, recognition, scoring, transcripts
from veilscribe.operators.detect import Model, detect, model_output, model_spans, span_counts
from veilscribe.operators.selection import in_file_order, last_segment_number, unprocessed
from veilscribe.shared import checkpointed
from veilscribe.sources import files, sinks


def _segments(spark: SparkSession, folder: str | None) -> DataFrame:
    path = posixpath.join(folder, "segments.jsonl") if folder else ""
    return files.read_jsonl(spark, path or "/nonexistent/segments.jsonl", schemas.SEGMENTS, pos="_pos")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_jsonl(spark, posixpath.join(folder, "spans.jsonl"), schemas.SPAN_ROWS, pos="_pos")


def _meta(folder: str, stage: str, config: dict, **more: Any) -> None:
    sinks.write_json(posixpath.join(folder, "run_meta.json"), sinks.run_meta(stage, config.get("run", {}).get("run_id", stage), **more))


def asr_policy(asr: dict) -> recognition.Policy:
    """The policy of a configuration's ``asr`` part.  Mixed segments are only decoded again if the language is left open."""
    code = lambda raw: (lambda c: LANGUAGE_ALIASES.get(c, c) or "auto")(str(raw or "").strip().lower())
    language, mixed = code(asr.get("language", "auto")), asr.get("mixed_language") or {}
    allowed = tuple(dict.fromkeys(c for c in map(code, mixed.get("languages", ["en", "zh"])) if c != "auto")) or ("en", "zh")
    seconds = lambda name, default: max(0.0, float(asr.get(name, default) or 0.0))
    return recognition.Policy(None if language == "auto" else language, seconds("max_segment_sec", 12.0), seconds("segment_overlap_sec", 0.8), bool(mixed.get("enabled", False)) and language == "auto", allowed, code(mixed.get("fallback_language", "en")))


def run_asr(spark: SparkSession, config: dict, root: str, make: Callable[[], recognition.Engine]) -> str:
    """Transcribe what is not transcribed yet; segments are appended and numbered on."""
    run, asr = config.get("run", {}), config.get("asr", {})
    out = sinks.artifact_dir(root, "asr", run.get("run_id", "asr_run"))
    began, target = time.time(), posixpath.join(out, "segments.jsonl")
    inputs = files.asr_inputs(spark, config.get("data", {}), root=config.get("project_root", root))
    there = checkpointed(_segments(spark, out)) if files.exists(spark, target) else _segments(spark, None)
    resume = bool(run.get("resume", True))
    todo = unprocessed(inputs, there) if resume else inputs
    last = there.agg(last_segment_number(there)).first()[0] if resume else None
    policy = asr_policy(asr)
    found = checkpointed(recognition.transcribe(todo, make, policy, checkpoint=checkpointed))
    numbered = recognition.with_segment_ids(found, last=-1 if last is None else last)
    sinks.write_jsonl(numbered, target, mode="append" if resume else "overwrite")
    audio = inputs.agg(F.sum(F.coalesce("duration_sec", F.lit(0.0)))).first()[0] if "duration_sec" in inputs.columns else None
    counts = found.agg(F.count_if(F.col("error").isNull()).alias("new_segments"), F.count_distinct(F.when(F.col("error").isNull(), F.col("source_item_id"))).alias("files_done"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("source_item_id"))).alias("files_failed")).first().asDict()
    elapsed = time.time() - began
    sinks.write_json(posixpath.join(out, "summary.json"), {"elapsed_sec": elapsed, "total_audio_sec": audio, "rtf": elapsed / audio if audio else None, "audio_sec_per_wall_sec": audio / elapsed if audio and elapsed else None, "segments": counts["new_segments"] + there.count(), **counts})
    _meta(out, "asr", config, **counts)
    return out


def run_pii(spark: SparkSession, config: dict, root: str, model: Callable[[], Model] | None = None) -> str:
    """Detect personal data in segments and write a row of spans for each."""
    run, pii = config.get("run", {}), config.get("pii", {})
    out = sinks.artifact_dir(root, "pii", run.get("run_id", "pii_run"))
    post = config.get("postprocess", {})
    segments = _segments(spark, run.get("input_asr_dir")).select("segment_id", "audio_path", "text", "_pos")
    found = detect(
        segments, rules=bool(pii.get("enable_rules", True)), toggles=pii.get("rules", {}), model=model, aliases=pii.get("ner", {}).get("label_map"), threshold=pii.get("ner", {}).get("score_threshold"),
        merge_gap=int(post.get("merge_gap_chars", 0) or 0), min_chars=int(post.get("min_span_chars", 1) or 1),
    )
    sinks.write_jsonl(found.select("segment_id", "audio_path", "text", "spans"), posixpath.join(out, "spans.jsonl"))
    written = _spans(spark, out)
    types = {r["pii_type"]: r["n_spans"] for r in span_counts(written).collect()}  # a row for each type
    _meta(out, "pii", config, input_asr_dir=run.get("input_asr_dir"), rows=written.count(), spans_by_type=types)
    return out


def run_mask(spark: SparkSession, config: dict, root: str) -> str:
    """Mask the audio of segments with spans and write the audit of each source."""
    run = config.get("run", {})
    out = sinks.artifact_dir(root, "masked", run.get("run_id", "masked_run"))
    options, spans_dir = masking.MaskOptions.of(config.get("mask", {})), run["input_pii_dir"]
    asr_dir = run.get("input_asr_dir") or files.read_json(posixpath.join(spans_dir, "run_meta.json")).get("input_asr_dir")
    placed = masking.placed_spans(_spans(spark, spans_dir), _segments(spark, asr_dir), options)
    audit = checkpointed(masking.mask_files(masking.audit_sources(placed, options), posixpath.join(out, "masked_audio"), options, root=config.get("project_root", root)))
    sinks.write_jsonl(audit.select(*schemas.AUDIT.names), posixpath.join(out, "audit.jsonl"))
    _meta(out, "masked", config, input_pii_dir=spans_dir, input_asr_dir=asr_dir, **sinks.summary_row(masking.mask_totals(audit)))
    return out


def run_eval(spark: SparkSession, config: dict, root: str) -> str:
    """Counts of spans by type and of segments by language."""
    run, inputs = config.get("run", {}), config.get("inputs", {})
    out = sinks.artifact_dir(root, "eval", run.get("run_id", "eval_run"))
    segments, spans = _segments(spark, inputs.get("asr_dir") or None), _spans(spark, inputs.get("pii_dir") or "/nonexistent")
    # no language at all and an explicit null read alike; both count as unknown
    by_lang = segments.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("count"))
    by_type = span_counts(spans).withColumnRenamed("n_spans", "count")
    sinks.write_csv(by_type, posixpath.join(out, "per_type.csv"), order=["pii_type"])
    sinks.write_csv(by_lang, posixpath.join(out, "per_lang.csv"), order=["language"])
    types, langs = {r[0]: r[1] for r in by_type.collect()}, {r[0]: r[1] for r in by_lang.collect()}
    sinks.write_json(posixpath.join(out, "summary.json"), {"run_id": run.get("run_id"), "num_segments": segments.count(), "num_records_with_spans": spans.count(), "total_detected_spans": sum(types.values()), "types_detected": types, "languages_seen": langs})
    _meta(out, "eval", config, inputs=inputs)
    return out


def run_asr_eval(spark: SparkSession, config: dict, root: str) -> str:
    """Error rates of each split: by conversation, by language and over all.

    The rates over conversations are those of one alignment of all their tokens in the
    order of the manifest; ``corpus_mode: sum_edits`` takes the summed edits instead.
    """
    run, protocol = config.get("run", {}), config.get("protocol", {})
    out = sinks.artifact_dir(root, "asr_eval", run.get("run_id", "asr_eval_v1"))
    all_scores, corpus, summaries, summed = None, None, [], protocol.get("corpus_mode") == "sum_edits"
    for entry in config.get("inputs", {}).get("evaluations", []):
        manifest = files.read_jsonl(spark, entry["manifest_path"], schemas.MANIFEST, pos="_pos")
        raw = _segments(spark, entry["asr_dir"])
        used = transcripts.first_by_id(raw, "segment_id", "_pos")
        hypotheses = transcripts.joined_hypotheses(used)
        scores = checkpointed(transcripts.score_conversations(manifest, hypotheses, split=entry["name"], numbers=bool(protocol.get("normalize_numbers", False)), aligned=True))
        n_raw, n_used = raw.count(), used.count()
        runtime = files.read_json(posixpath.join(entry["asr_dir"], "summary.json"))
        summaries.append({"split": entry["name"], "segments_rows_raw": n_raw, "segments_rows_used": n_used, "duplicate_segment_rows_removed": n_raw - n_used, "num_hyp_conversations": hypotheses.count(), "asr_runtime": runtime})
        if summed:
            found = checkpointed(transcripts.summed_scores(scores))
        else:
            found = checkpointed(transcripts.corpus_scores(manifest, hypotheses, split=entry["name"], numbers=bool(protocol.get("normalize_numbers", False))))
        corpus = found if corpus is None else corpus.unionByName(found)
        all_scores = scores if all_scores is None else all_scores.unionByName(scores)
    if all_scores is None:
        raise ValueError("inputs.evaluations is required")
    sinks.write_jsonl(all_scores.select(*schemas.CONVERSATION_SCORES.names), posixpath.join(out, "per_conversation.jsonl"))
    sinks.write_csv(corpus.filter("lang_bucket != 'ALL'"), posixpath.join(out, "per_language.csv"), order=["split", "lang_bucket"])
    sinks.write_csv(all_scores.select(*schemas.CONVERSATION_SCORES.names), posixpath.join(out, "per_conversation.csv"))
    overall = [r.asDict() for r in corpus.filter("lang_bucket = 'ALL'").collect()]  # a row for each split
    sinks.write_csv(corpus.filter("lang_bucket = 'ALL'"), posixpath.join(out, "per_split.csv"), order=["split"])
    sinks.write_json(posixpath.join(out, "protocol.json"), {"version": protocol.get("version", "asr_eval_v1"), "normalize_numbers": bool(protocol.get("normalize_numbers", False)), "corpus_rate": "sum_edits" if summed else "one_alignment"})
    sinks.write_json(posixpath.join(out, "summary.json"), {"splits": [{**s, **next(o for o in overall if o["split"] == s["split"])} for s in summaries]})
    _meta(out, "asr_eval", config)
    return out


def run_pii_eval(spark: SparkSession, config: dict, root: str, model: Callable[[], Model]) -> str:
    """Strict BIO scores of a model on labelled sentences: by split, type and sentence."""
    run, protocol, ner = config.get("run", {}), config.get("protocol", {}), config.get("pii", {}).get("ner", {})
    out = sinks.artifact_dir(root, "pii_eval", run.get("run_id", "pii_eval_v1"))
    allowed = sorted({t.strip().upper() for t in protocol.get("allowed_entity_types", ["PER", "ORG", "LOC"]) if t.strip()})
    if not allowed:
        raise ValueError("protocol.allowed_entity_types must contain at least one entity type")
    beta, items = float(protocol.get("beta", 1.0)), None
    for entry in config.get("inputs", {}).get("evaluations", []):
        rows = in_file_order(files.read_jsonl(spark, entry["data_path"], schemas.BIO_SENTENCES, pos="_pos"), int(protocol.get("max_items_per_split") or 0)).withColumn("split", F.lit(entry["name"]))
        text = F.array_join("tokens", " ")
        rows = rows.withColumn("raw", model_output(model)(text)).withColumn("predicted", model_spans(F.col("raw"), text, aliases=protocol.get("label_aliases"), allowed=allowed, threshold=ner.get("score_threshold")))
        part = scoring.bio_items(rows, allowed, spans_col="predicted")
        items = part if items is None else items.unionByName(part)
    if items is None:
        raise ValueError("inputs.evaluations is required")
    items = checkpointed(items)
    scores = scoring.bio_scores(items)
    by_type = scoring.type_scores(scoring.bio_outcomes(items), beta)
    sinks.write_jsonl(scores, posixpath.join(out, "per_item.jsonl"))
    sinks.write_csv(by_type, posixpath.join(out, "per_type.csv"), order=["split", "type"])
    summary = scoring.bio_summary(scores, beta)
    sinks.write_csv(summary.filter("split != 'ALL'"), posixpath.join(out, "per_split.csv"), order=["split"])
    rows = [r.asDict() for r in summary.collect()]  # a row for each split
    sinks.write_json(posixpath.join(out, "protocol.json"), {"version": protocol.get("version", "pii_ner_eval_v1"), "scheme": "entity_level_strict_bio", "beta": beta, "allowed_entity_types": allowed})
    sinks.write_json(posixpath.join(out, "summary.json"), {"overall": next(r for r in rows if r["split"] == "ALL"), "splits": [r for r in rows if r["split"] != "ALL"]})
    _meta(out, "pii_eval", config)
    return out


def run_pii_eval_gold(spark: SparkSession, config: dict, root: str, model: Callable[[], Model] | None = None) -> str:
    """Overlap scores of predictions, or of detection run here, against gold annotations."""
    run, protocol, inputs = config.get("run", {}), config.get("protocol", {}), config.get("inputs", {})
    out = sinks.artifact_dir(root, "pii_eval", run.get("run_id", "pii_eval_gold_v1"))
    beta = float(protocol.get("beta", 2.0))
    gold = files.read_jsonl(spark, inputs.get("gold_path", "data/prepared/gold_set/dev.jsonl"), schemas.GOLD, pos="_pos")
    if inputs.get("pred_path"):
        predictions = files.read_jsonl(spark, inputs["pred_path"], schemas.PREDICTIONS)
    else:
        pii, post = config.get("pii", {}), config.get("postprocess", {})
        predictions = detect(gold.select("record_id", "transcript"), rules=bool(pii.get("enable_rules", True)), toggles=pii.get("rules", {}), model=model, aliases=pii.get("ner", {}).get("label_map"), text_col="transcript", merge_gap=int(post.get("merge_gap_chars", 0) or 0), min_chars=int(post.get("min_span_chars", 1) or 1))
    matched = checkpointed(scoring.match_records(predictions, gold, threshold=float(protocol.get("overlap_threshold", 0.5)), pos="_pos"))
    sinks.write_jsonl(scoring.record_scores(matched, beta), posixpath.join(out, "per_record.jsonl"))
    sinks.write_jsonl(scoring.record_errors(matched), posixpath.join(out, "errors.jsonl"))
    by = checkpointed(scoring.scores_by(scoring.outcomes(matched), "type", "language", beta=beta, digits=4))
    sinks.write_csv(by.filter("scope = 'type'"), posixpath.join(out, "per_type.csv"), order=["value"])
    sinks.write_csv(by.filter("scope = 'language'"), posixpath.join(out, "per_lang.csv"), order=["value"])
    overall = [r.asDict() for r in by.filter("scope = 'overall'").collect()]
    sinks.write_json(posixpath.join(out, "summary.json"), {"overall": overall[0] if overall else {}, "num_records": matched.count(), "beta": beta})
    _meta(out, "pii_eval", config)
    return out


def run_pipeline(spark: SparkSession, manifest: str, root: str, run_id: str, make: Callable[[], recognition.Engine], *, model: Callable[[], Model] | None = None, mask: dict | None = None, rules: dict | None = None) -> dict[str, Any]:
    """Audio to masked audio and counts: recognition, detection, masking, evaluation, and a bundle of the small results."""
    asr = run_asr(spark, {"run": {"run_id": run_id}, "data": {"source_type": "manifest", "manifest": {"path": manifest}}, "project_root": root}, root, make)
    pii = run_pii(spark, {"run": {"run_id": run_id, "input_asr_dir": asr}, "pii": {"rules": rules or {}}, "postprocess": {"merge_gap_chars": 1, "min_span_chars": 2}}, root, model)
    masked = run_mask(spark, {"run": {"run_id": run_id, "input_pii_dir": pii}, "mask": mask or {}, "project_root": root}, root)
    counted = run_eval(spark, {"run": {"run_id": run_id}, "inputs": {"asr_dir": asr, "pii_dir": pii}}, root)
    found = sinks.bundle(posixpath.join(root, f"{run_id}.zip"), [posixpath.join(f, "run_meta.json") for f in (asr, pii, masked, counted)] + [posixpath.join(counted, "summary.json")], root=root)
    return {"asr": asr, "pii": pii, "masked": masked, "eval": counted, "bundle": found}
