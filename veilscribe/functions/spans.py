"""Character spans of a text: cleaning, merging, redaction, location and comparison.

A span is a struct<start, end, type, text, score, source> with half-open code point offsets.
All of it works within a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscribe.functions.binding import let
from veilscribe.functions.matches import make_span, no_spans
from veilscribe.functions.text import strip


def clean_spans(text: Column, spans: Column, min_chars: int) -> Column:
    """Proper spans of ``min_chars`` or more, one for each (start, end, type), sorted by these; the first given wins.

    Texts are cut anew from ``text``; a null array is an empty one.
    """

    def keyed(s, i):
        kind = F.coalesce(strip(s["type"]), F.lit(""))
        start, end = F.coalesce(s["start"], F.lit(-1)), F.coalesce(s["end"], F.lit(-1))
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("type"), i.alias("i"), s["score"].alias("score"), s["source"].alias("source"))

    proper = F.filter(F.transform(F.coalesce(spans, no_spans()), keyed), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["type"] != "") & (s["end"] - s["start"] >= min_chars))

    def distinct(ordered):
        # a sorted array and the same one place on, side by side
        pairs = F.arrays_zip(ordered.alias("now"), F.concat(F.array(F.lit(None)), ordered).alias("before"))
        key = lambda x: F.struct(x["start"], x["end"], x["type"])
        new = F.filter(pairs, lambda p: p["now"].isNotNull() & (p["before"].isNull() | (key(p["now"]) != key(p["before"]))))
        return F.transform(new, lambda p: make_span(p["now"]["start"], p["now"]["end"], p["now"]["type"], F.substr(text, p["now"]["start"] + 1, p["now"]["end"] - p["now"]["start"]), p["now"]["source"], p["now"]["score"]))

    return let(F.array_sort(proper), distinct)


def merge_adjacent(text: Column, spans: Column, gap: int) -> Column:
    """Sorted spans, joined where one starts at most ``gap`` after the end of the one before and has its type.

    A span of another type in between keeps two apart; the joined span has the score and
    source of its first.
    """

    def joined(last, s):
        end = F.greatest(last["end"], s["end"])
        return make_span(last["start"], end, last["type"], F.substr(text, last["start"] + 1, end - last["start"]), last["source"], last["score"])

    def step(acc, s):
        join = (acc["last"]["type"] == s["type"]) & (s["start"] <= acc["last"]["end"] + gap)
        return F.when(F.coalesce(join, F.lit(False)), F.struct(acc["out"].alias("out"), joined(acc["last"], s).alias("last"))).otherwise(
            F.struct(F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))).alias("out"), s.alias("last"))
        )

    start = F.struct(no_spans().alias("out"), F.try_element_at(no_spans(), F.lit(1)).alias("last"))
    merged = lambda given: F.aggregate(given, start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))
    return let(spans, lambda given: F.when(F.size(given) < 2, given).otherwise(merged(given)))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with ``[TYPE]`` for each span, in order; spans that start within the one before, or beyond the end, are left out."""
    text, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    ordered = F.array_sort(F.transform(F.coalesce(spans, no_spans()), lambda s, i: F.struct(F.coalesce(s["start"], F.lit(-1)).alias("start"), F.coalesce(s["end"], F.lit(-1)).alias("end"), i.alias("i"), F.upper(F.coalesce(s["type"], F.lit("PII"))).alias("type"))))

    def step(acc, s):
        use = (s["start"] >= 0) & (s["end"] > s["start"]) & (s["start"] >= acc["at"]) & (s["start"] <= n)
        piece = F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["type"], F.lit("]")))
        return F.when(use, F.struct(F.concat(acc["out"], piece).alias("out"), F.least(s["end"], n).alias("at"))).otherwise(acc)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(ordered, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, n))), ""))
    return F.when((n == 0) | (F.size(F.coalesce(spans, no_spans())) == 0), text).otherwise(whole)


def _unused(text: Column, wanted: Column, used: Column) -> Column:
    """The place (0-based) of the first occurrence whose place is not used; -1 if there is none."""
    steps = F.sequence(F.lit(0), F.size(used))
    at = F.aggregate(steps, _locate(wanted, text, F.lit(1)), lambda at, _: F.when((at > 0) & F.array_contains(used, at - 1), _locate(wanted, text, at + 1)).otherwise(at))
    return at - 1


def _locate(wanted: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", wanted, text, start)


def locate_entities(text: Column, entities: Column) -> Column:
    """Entities (pii_type, text, start_char, end_char) with the offsets they lack.

    Each takes the first occurrence of its text whose start no entity before it has
    taken, else the first occurrence, else nulls.  Offsets that are there stay.
    """

    def step(acc, e):
        given = F.coalesce((e["start_char"] >= 0) & (e["end_char"] > e["start_char"]), F.lit(False))
        blank = F.coalesce(e["text"] == "", F.lit(True))

        def placed(fresh):
            at = F.when(fresh >= 0, fresh).otherwise(_locate(e["text"], text, F.lit(1)) - 1)
            start = F.when(given | blank, e["start_char"]).when(at >= 0, at)
            end = F.when(given | blank, e["end_char"]).when(at >= 0, at + F.length(e["text"]))
            taken = F.when(blank, None).when(given, e["start_char"]).when(fresh >= 0, fresh)
            found = F.struct(e["pii_type"].alias("pii_type"), e["text"].alias("text"), start.cast("int").alias("start_char"), end.cast("int").alias("end_char"))
            return F.struct(F.concat(acc["out"], F.array(found)).alias("out"), F.when(taken.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(taken.cast("int")))).alias("used"))

        return let(_unused(text, e["text"], acc["used"]), placed)

    nothing = F.expr("cast(array() as array<struct<pii_type: string, text: string, start_char: int, end_char: int>>)")
    return F.aggregate(F.coalesce(entities, nothing), F.struct(nothing.alias("out"), F.array().cast("array<int>").alias("used")), step, lambda acc: acc["out"])


# ------------------------------------------------------------------------- comparison


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the hull of two spans; 0 if they do not overlap."""
    low, high = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(low < high, (high - low) / (F.greatest(a_end, b_end) - F.least(a_start, b_start))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Either trimmed text is in the other and neither is empty."""
    a, b = strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def best_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The overlap over the shorter of the two lengths, each at least 1."""
    over = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.greatest(over / F.greatest(F.lit(1), a_end - a_start), over / F.greatest(F.lit(1), b_end - b_start))


_PAIRS = "cast(array() as array<struct<gi: int, pi: int, overlap: double>>)"


def greedy_pairs(gold: Column, predicted: Column, threshold: float = 0.5) -> Column:
    """array<struct<gi, pi, overlap>>: each gold entity, in order, with the free prediction of its type that overlaps it best.

    A prediction counts if its IoU reaches ``threshold``; if none does so before it, the
    first that contains the text or is contained in it counts at 0.5, and a later one
    takes over with a greater IoU.
    """

    def best(acc, g):
        def step(held, p, pi):
            free = ~F.exists(acc, lambda x: x["pi"] == pi) & (F.upper(F.coalesce(p["type"], F.lit(""))) == F.upper(F.coalesce(g["pii_type"], F.lit(""))))
            placed = g["start_char"].isNotNull() & g["end_char"].isNotNull() & p["start"].isNotNull() & p["end"].isNotNull()
            share = F.when(placed, iou(p["start"], p["end"], g["start_char"], g["end_char"])).otherwise(0.0)
            matched = placed & (share >= threshold)
            takes = free & matched & (share > held["o"])
            contains = free & ~matched & containment(p["text"], g["text"]) & (held["pi"] == -1)
            return F.when(takes, F.struct(pi.alias("pi"), share.alias("o"))).when(contains, F.struct(pi.alias("pi"), F.lit(0.5).alias("o"))).otherwise(held)

        numbered = F.transform(predicted, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        return F.aggregate(numbered, F.struct(F.lit(-1).alias("pi"), F.lit(0.0).alias("o")), lambda held, x: step(held, x["p"], x["i"]))

    def outer(acc, x):
        found = F.filter(F.array(best(acc, x["g"])), lambda f: f["pi"] >= 0)
        return F.concat(acc, F.transform(found, lambda f: F.struct(x["i"].alias("gi"), f["pi"].alias("pi"), f["o"].alias("overlap"))))

    numbered = F.transform(gold, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    pairs = F.aggregate(numbered, F.expr(_PAIRS), outer)
    return F.when((F.size(gold) > 0) & (F.size(predicted) > 0), pairs).otherwise(F.expr(_PAIRS))


def first_hit_pairs(gold: Column, predicted: Column, threshold: float = 0.5) -> Column:
    """Like ``greedy_pairs``, but the first free prediction of the same type wins that shares ``threshold`` of either length or contains the text untrimmed; gold without offsets matches nothing."""

    def hit(p, g):
        share = best_share(g["start_char"], g["end_char"], p["start"], p["end"])
        a, b = F.coalesce(p["text"], F.lit("")), F.coalesce(g["text"], F.lit(""))
        return (F.coalesce(p["type"], F.lit("")) == F.coalesce(g["pii_type"], F.lit(""))) & ((share >= threshold) | a.contains(b) | b.contains(a))

    def outer(acc, x):
        g = x["g"]
        numbered = F.transform(predicted, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        free = F.filter(numbered, lambda y: g["start_char"].isNotNull() & g["end_char"].isNotNull() & ~F.exists(acc, lambda z: z["pi"] == y["i"]) & hit(y["p"], g))
        share = lambda p: best_share(g["start_char"], g["end_char"], p["start"], p["end"])
        return F.concat(acc, F.transform(F.slice(free, 1, 1), lambda y: F.struct(x["i"].alias("gi"), y["i"].alias("pi"), share(y["p"]).alias("overlap"))))

    numbered = F.transform(gold, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    pairs = F.aggregate(numbered, F.expr(_PAIRS), outer)
    return F.when((F.size(gold) > 0) & (F.size(predicted) > 0), pairs).otherwise(F.expr(_PAIRS))
