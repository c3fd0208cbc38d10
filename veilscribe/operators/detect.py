"""Detection of personal data: rules, a model and a language model, united and merged.

Models are plugged in as functions of texts; nothing is downloaded.  ``gazetteer`` is a
deterministic stand-in for a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscribe.functions.matches import make_span, no_spans
from veilscribe.functions.spans import clean_spans, locate_entities, merge_adjacent, redact
from veilscribe.functions.text import remapped_label, strip
from veilscribe.operators.rules import rule_spans

RAW = "array<struct<label: string, start: int, end: int, score: double>>"
#: What a model gives for a text: dictionaries with label, start, end and score.
Model = Callable[[str], list[dict]]
# ---- fixed value: the types that a language model may give
LLM_TYPES = ("NAME", "PHONE", "EMAIL", "ADDRESS", "ID")


def gazetteer(entries: dict[str, str], score: float = 0.99) -> Callable[[], Model]:
    """A maker of models that find the keys of ``entries`` in a text and label them with the values."""

    def make() -> Model:
        def model(text: str) -> list[dict]:
            found = []
            for name, label in entries.items():
                at = text.find(name)
                while at >= 0:
                    found.append({"entity_group": label, "start": at, "end": at + len(name), "score": score})
                    at = text.find(name, at + len(name))
            return found

        return model

    return make


def model_output(make: Callable[[], Model]):
    """A pandas UDF of texts that makes the model once per Python worker task and skips blank texts."""

    @F.pandas_udf(RAW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        number = lambda x: float(x) if isinstance(x, (int, float)) else None
        whole = lambda x: x if isinstance(x, int) else None
        # a few texts at a time: what a model finds in a whole batch of texts may be much larger than the batch
        for texts in (batch.iloc[k : k + 256] for batch in batches for k in range(0, len(batch), 256)):
            yield pd.Series([[{"label": e.get("entity_group") or e.get("entity"), "start": whole(e.get("start")), "end": whole(e.get("end")), "score": number(e.get("score"))} for e in model(t)] if t and t.strip() else [] for t in texts])

    return run


#: What a language model is asked for when nothing else is said.
INSTRUCTIONS = (
    "Find the personal data in the text that follows. Answer with a JSON array and nothing else. Each element is an object with two strings: "
    f"pii_type, which is one of {', '.join(LLM_TYPES)}, and text, copied letter by letter from the text. Answer [] if there is none."
)
#: Gives a language model's answer to instructions and a text.
Ask = Callable[[str, str], str]


def llm_output(make: Callable[[], Ask], instructions: str = INSTRUCTIONS):
    """A pandas UDF of texts that gives a language model's answers.

    ``make`` is called once per task and may open a connection.  Blank texts are not sent.
    A call that fails costs its own answer, which is then null, and not the task.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make()

        def answer(text):
            if not text or not text.strip():
                return None
            try:
                return ask(instructions, text)
            except Exception:  # noqa: BLE001  whatever a caller's client raises
                return None

        for texts in batches:
            yield texts.map(answer, na_action=None).astype(object)

    return run


def model_spans(raw: Column, text: Column, *, aliases: dict[str, str] | None = None, allowed: list[str] | None = None, threshold: float | None = None) -> Column:
    """Spans of a model's raw entities: labels mapped, those not allowed, without a length or below the threshold left out; a null score passes."""
    mapped = F.transform(raw, lambda e: make_span(e["start"], e["end"], remapped_label(e["label"], aliases or {}), F.substr(text, e["start"] + 1, e["end"] - e["start"]), F.lit("ner"), e["score"]))
    sound = lambda s: (s["type"] != "") & s["start"].isNotNull() & (s["end"] > s["start"])
    kept = F.filter(mapped, lambda s: F.coalesce(sound(s), F.lit(False)))
    if allowed:
        kept = F.filter(kept, lambda s: s["type"].isin(*(a.strip().upper() for a in allowed)))
    if threshold is not None:
        kept = F.filter(kept, lambda s: s["score"].isNull() | (s["score"] >= threshold))
    ordered = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["type"].alias("c"), i.alias("i"), s.alias("s"))))
    return F.transform(ordered, lambda x: x["s"])


def llm_spans(text: Column, response: Column) -> Column:
    """Spans of a language model's answer: JSON, or the part of it from the first ``[`` to the last ``]``.

    Anything but a list gives none; entries of other types, or whose text is not in
    ``text``, are left out.
    """
    text, response = F.coalesce(text, F.lit("")), F.coalesce(response, F.lit(""))
    inner = F.regexp_extract(response, r"(?s)\[.*\]", 0)
    given = F.when(F.try_parse_json(response).isNotNull(), response).when(F.try_parse_json(inner).isNotNull(), inner)
    # null unless it is a list; fields of what is no object are null
    parsed = F.try_variant_get(F.try_parse_json(given), "$", "array<variant>")
    nothing = F.expr("cast(array() as array<struct<pii_type: string, text: string, start_char: int, end_char: int>>)")
    part = lambda e, name: F.try_variant_get(e, f"$.{name}", "string")
    entity = lambda e: F.struct(F.upper(part(e, "pii_type")).alias("pii_type"), strip(part(e, "text")).alias("text"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
    wanted = F.filter(F.coalesce(F.transform(parsed, entity), nothing), lambda e: F.coalesce(e["pii_type"].isin(*LLM_TYPES) & (e["text"] != ""), F.lit(False)))
    placed = F.filter(locate_entities(text, wanted), lambda e: e["start_char"].isNotNull())
    return F.transform(placed, lambda e: make_span(e["start_char"], e["end_char"], e["pii_type"], e["text"], F.lit("llm")))


def detect(
    segments: DataFrame, *, rules: bool = True, toggles: dict[str, bool] | None = None, model: Callable[[], Model] | None = None, aliases: dict[str, str] | None = None, threshold: float | None = None,
    responses: str | None = None, llm: Callable[[], Ask] | None = None, instructions: str = INSTRUCTIONS, text_col: str = "text", spans_col: str = "spans", merge_gap: int = 1, min_chars: int = 2,
) -> DataFrame:
    """``segments`` with their merged spans: of rules, then of a model, then of a language model, by its ``responses`` column or by asking it (``llm``).

    Of equal spans the first source wins.  One narrow stage; Python runs only for models,
    in Arrow batches, and not on blank texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    out = segments
    if model:
        out = out.withColumn(f"{spans_col}__model", model_output(model)(F.col(text_col)))
    if rules:
        parts.append(rule_spans(F.col(text_col), toggles))
    if model:
        parts.append(model_spans(F.col(f"{spans_col}__model"), text, aliases=aliases, threshold=threshold))
    if responses:
        parts.append(llm_spans(text, F.col(responses)))
    if llm:
        out = out.withColumn(f"{spans_col}__answer", llm_output(llm, instructions)(F.col(text_col)))
        parts.append(llm_spans(text, F.col(f"{spans_col}__answer")))
    raw = F.concat(*parts) if parts else no_spans()
    out = out.withColumn(f"{spans_col}__raw", raw)
    return out.withColumn(spans_col, merge_adjacent(text, clean_spans(text, F.col(f"{spans_col}__raw"), min_chars), merge_gap)).drop(f"{spans_col}__raw", f"{spans_col}__model", f"{spans_col}__answer")


def redacted(spans: DataFrame, *, text_col: str = "text", spans_col: str = "spans", out_col: str = "redacted") -> DataFrame:
    return spans.withColumn(out_col, redact(F.col(text_col), F.col(spans_col)))


def span_counts(spans: DataFrame, *, spans_col: str = "spans") -> DataFrame:
    """pii_type, n_spans over all rows; partial counts before the shuffle."""
    return spans.select(F.explode(spans_col).alias("s")).groupBy(F.coalesce("s.type", F.lit("UNKNOWN")).alias("pii_type")).agg(F.count("*").alias("n_spans"))


def segment_table(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments with their number of spans and redacted text; of span rows with the same segment the last by ``_pos`` counts."""
    last = spans.groupBy("segment_id").agg(F.max_by("spans", "_pos").alias("spans"))
    out = segments.join(last, "segment_id", "left")
    start = F.round(F.coalesce("start", F.lit(0.0)), 2)
    return out.select(
        "segment_id", F.coalesce("language", F.lit("unknown")).alias("language"), start.alias("start"), F.round("end", 2).alias("end"),
        F.greatest(F.size(F.coalesce("spans", no_spans())), F.lit(0)).alias("detected_spans"), F.coalesce("text", F.lit("")).alias("transcript"), redact(F.col("text"), F.col("spans")).alias("redacted_transcript"),
    )
