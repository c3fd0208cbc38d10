"""Regular expression matches with their offsets, without leaving the JVM.

What lies between matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running lengths give the offsets.  Offsets are
half-open and count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscribe.schemas import SPAN

NO_SPANS = f"cast(array() as array<{SPAN}>)"


def no_spans() -> Column:
    return F.expr(NO_SPANS)


def make_span(start: Column, end: Column, kind: Column, text: Column, source: Column, score: Column | None = None) -> Column:
    score = F.lit(None).cast("double") if score is None else score
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"), text.alias("text"), score.alias("score"), source.alias("source"))


def find_spans(text: Column, pattern: str, kind: str, *, group: int = 0, source: str = "rule", hints: tuple[str, ...] = ()) -> Column:
    """All leftmost matches that do not overlap, as spans.

    A captured group must end its match, look-ahead aside.  ``hints`` are patterns that
    are found faster and that every text with a match has; other texts are not searched.
    What is left is searched once before matches are taken apart, as most have none.
    """
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc, m):
        end = acc["at"] + F.length(m["gap"]) + F.length(m["whole"])
        found = make_span(end - F.length(m["value"]), end, F.lit(kind), m["value"], F.lit(source))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), no_spans().alias("out")), step, lambda acc: acc["out"])
    some = text.rlike(pattern)
    for hint in reversed(hints):
        some = text.rlike(hint) & some
    return F.when(some, spans).otherwise(no_spans())
