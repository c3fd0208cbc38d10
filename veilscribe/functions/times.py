"""Time axes in double seconds: windows, chunks, and places of characters in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscribe.functions.binding import let
from veilscribe.functions.text import CJK, strip

INTERVALS = "array<struct<start: double, end: double>>"
#: Words with their places in the text.
WORD_PLACES = "array<struct<start_char: int, end_char: int, start_sec: double, end_sec: double, text: string>>"
# ---- fixed value: words before a name that belong to its token
NAME_CUES = ("我叫", "我是", "名叫", "叫做", "叫")


def seconds(value: Column) -> Column:
    """A number or a numeric string as seconds, else null."""
    return value.try_cast("double")


def usable_words(words: Column) -> Column:
    """Word timestamps that have a length."""
    return F.filter(F.coalesce(words, F.expr("cast(array() as array<struct<word: string, start: double, end: double, probability: double>>)")), lambda w: w["end"] > w["start"])


# ------------------------------------------------------------------------ windows, chunks


def clip_windows(start: Column, end: Column, longest: float) -> Column:
    """Consecutive windows of at most ``longest`` seconds; one if that is not above 0; none without a length."""
    start, end = start.cast("double"), end.cast("double")
    one = F.array(F.struct(start.alias("start"), end.alias("end")))
    if longest <= 0:
        out = one
    else:
        n = F.ceil((end - start) / longest).cast("int")
        out = F.when(end - start <= longest, one).otherwise(
            F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct((start + i * longest).alias("start"), F.least(end, start + (i + 1) * longest).alias("end"))), lambda w: w["end"] > w["start"])
        )
    return F.when(end > start, out).otherwise(F.expr(f"cast(array() as {INTERVALS})"))


def chunk_ranges(total: Column, chunk: float, overlap: float, shortest: float) -> Column:
    """Chunks that overlap; those shorter than ``shortest`` are left out, and the first that reaches the end is the last."""
    step, total = max(0.5, chunk - overlap), total.cast("double")
    last = F.greatest(F.lit(0), F.ceil((total - chunk) / step).cast("int"))
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("double").alias("start"), F.least(i * step + chunk, total).alias("end")))
    return F.when(total > 0, F.filter(spans, lambda w: (w["start"] < total) & (w["end"] - w["start"] >= shortest))).otherwise(F.expr(f"cast(array() as {INTERVALS})"))


def proportional_slices(text: Column, n: Column) -> Column:
    """``n`` slices of the stripped text of about equal length; an empty one is widened by five characters to both sides."""

    def cut(x):
        text, total = x["text"], x["total"]

        def piece(i):
            a, b = F.bround(i * total / n).cast("int"), F.bround((i + 1) * total / n).cast("int")
            low, high = F.greatest(F.lit(0), F.floor(i * total / n).cast("int") - 5), F.floor((i + 1) * total / n).cast("int") + 5
            return let(strip(F.substr(text, a + 1, b - a)), lambda exact: F.when(exact != "", exact).otherwise(strip(F.substr(text, low + 1, high - low))))

        return F.when(n <= 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), piece))

    return let(let(strip(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("text"), F.length(t).alias("total"))), cut)


def fixed_chunks(duration: Column, text: Column, chunk: float = 28.0, shortest: float = 2.0) -> Column:
    """array<struct<i, start, end, text>> of chunks of ``chunk`` seconds with their share of the text; short ones are left out."""
    n = F.greatest(F.lit(1), F.ceil(duration / chunk).cast("int"))
    slices = proportional_slices(text, n)
    chunks = F.transform(slices, lambda t, i: F.struct(i.alias("i"), (i * chunk).cast("double").alias("start"), F.least((i + 1) * F.lit(chunk), duration).alias("end"), t.alias("text")))
    return F.when(duration >= shortest, F.filter(chunks, lambda c: c["end"] - c["start"] >= shortest)).otherwise(F.filter(chunks, lambda c: F.lit(False)))


def with_context(start: Column, end: Column, overlap: float) -> Column:
    """A window and what to decode around it."""
    side = max(0.0, overlap)
    return F.struct(F.greatest(F.lit(0.0), start - side).alias("start"), (end + side).alias("end"))


def owned(start: Column, end: Column, core_start: Column, core_end: Column) -> Column:
    """Whether the middle of a decoded segment lies in the window."""
    middle = 0.5 * (start + end)
    return (end > start) & (middle >= core_start) & (middle < core_end)


def clamped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The part of [start, end) in [low, high); null if nothing is left."""
    a, b = F.greatest(start, low), F.least(end, high)
    return F.when(b > a, F.struct(a.alias("start"), b.alias("end")))


# ----------------------------------------------------------------- characters and time


def word_places(text: Column, words: Column) -> Column:
    """Where the words of a segment stand in its text.

    Each is looked for after the one before, else from the start: as it is, stripped,
    and without marks at its ends, in this order; words that are not found are left out.
    """
    text = F.coalesce(text, F.lit(""))
    nothing = F.expr(f"cast(array() as {WORD_PLACES})")

    def find(c, at):
        # a locate of null, or of what is not there, gives null
        seek = lambda start: F.nullif(F.call_function("locate", c, text, start), F.lit(0))
        return F.coalesce(seek(at + 1), F.when(at > 0, seek(F.lit(1))))

    def hit_of(token, at):
        bare = strip(token)
        trimmed = F.regexp_replace(bare, rf"(?U)\A[^\w{CJK}]+|[^\w{CJK}]+\z", "")
        options = F.transform(F.array(token, bare, trimmed), lambda c: F.struct(F.when(c != "", find(c, at)).alias("at"), F.length(c).alias("n")))
        return F.try_element_at(F.filter(options, lambda o: o["at"].isNotNull()), F.lit(1))

    def step(acc, w):
        def placed(hit):
            start, end = (hit["at"] - 1).cast("int"), (hit["at"] - 1 + hit["n"]).cast("int")
            place = F.struct(start.alias("start_char"), end.alias("end_char"), w["start"].alias("start_sec"), w["end"].alias("end_sec"), F.substr(text, hit["at"], hit["n"]).alias("text"))
            return F.when(hit.isNotNull(), F.struct(end.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))).otherwise(acc)

        return let(hit_of(F.coalesce(w["word"], F.lit("")), acc["at"]), placed)

    return F.when(text == "", nothing).otherwise(F.aggregate(usable_words(words), F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"]))


def covering_word(start: Column, end: Column, places: Column) -> Column:
    return F.try_element_at(F.filter(places, lambda w: (start >= w["start_char"]) & (end <= w["end_char"])), F.lit(1))


def char_time(at: Column, places: Column) -> Column:
    """The time of a character: within a word by its share of the word, between two words by its share of the gap, else null.

    ``places`` are sorted by their characters.
    """
    numbered = F.transform(places, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.try_element_at(places, F.greatest(i, F.lit(1)))).alias("before")))
    stop = F.try_element_at(F.filter(numbered, lambda x: x["w"]["end_char"] >= at), F.lit(1))

    def time(x):
        w, before = x["w"], x["before"]
        inside = F.when(w["end_char"] <= w["start_char"], w["start_sec"]).otherwise(w["start_sec"] + (at - w["start_char"]) / (w["end_char"] - w["start_char"]) * (w["end_sec"] - w["start_sec"]))
        chars, gap = w["start_char"] - before["end_char"], w["start_sec"] - before["end_sec"]
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - before["end_char"]) / chars))
        return F.when(w["start_char"] <= at, inside).when((chars > 0) & (gap >= 0), before["end_sec"] + share * gap)

    return let(stop, time)


def span_interval(span: Column, text: Column, seg_start: Column, seg_end: Column, places: Column, *, lead: float = 0.0, tail: float = 0.12, least: float = 0.2) -> Column:
    """struct<start, end, mode> of a span: by its words (``word``), else by its share of the text (``char_ratio``); null if it cannot be placed.

    ``places`` are those of ``word_places``; their order in the text decides.  A short
    Chinese name leads by 0.08 s more, and starts with its word after a cue such as 我叫.
    """
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    first = F.when(n > 0, F.greatest(F.lit(0), F.least(span["start"], n))).otherwise(F.lit(0))
    finite = ~F.isnan(seg_start) & ~F.isnan(seg_end) & (F.abs(seg_start) < float("inf")) & (F.abs(seg_end) < float("inf"))
    usable = finite & (seg_end > seg_start) & span["start"].isNotNull() & span["end"].isNotNull()

    def ends(a):
        b = F.when(n > 0, F.greatest(a + 1, F.least(span["end"], n))).otherwise(F.lit(1))
        return let(F.struct(a.alias("a"), b.alias("b"), F.array_sort(places).alias("ordered")), by_words)

    def by_words(x):
        times_ = F.struct(x["a"].alias("a"), x["b"].alias("b"), char_time(x["a"], x["ordered"]).alias("ta"), char_time(x["b"], x["ordered"]).alias("tb"), covering_word(x["a"], x["b"], places).alias("cover"))
        return let(times_, in_time)

    def in_time(x):
        by_word = F.coalesce(x["tb"] > x["ta"], F.lit(False))
        long = seg_end - seg_start
        start = F.when(by_word, x["ta"]).when(n <= 0, seg_start).otherwise(seg_start + x["a"] / n * long)
        end = F.when(by_word, x["tb"]).when(n <= 0, seg_end).otherwise(seg_start + x["b"] / n * long)
        words = F.coalesce(span["text"], F.lit(""))
        name = (F.upper(F.coalesce(span["type"], F.lit(""))) == "NAME") & words.rlike(f"[{CJK}]") & (F.length(words) <= 3)
        prefix = F.substr(text, x["cover"]["start_char"] + 1, x["a"] - x["cover"]["start_char"])
        cue = F.coalesce(prefix.rlike("|".join(NAME_CUES)), F.lit(False))
        s = F.greatest(seg_start, F.when(name & cue, x["cover"]["start_sec"]).otherwise(start) - lead - F.when(name, 0.08).otherwise(0.0))
        return let(F.struct(s.alias("start"), F.least(seg_end, end + tail).alias("end"), F.when(by_word, "word").otherwise("char_ratio").alias("mode")), widened)

    def widened(x):
        middle, narrow = 0.5 * (x["start"] + x["end"]), (x["end"] - x["start"]) < least
        s = F.when(narrow, F.greatest(seg_start, middle - 0.5 * least)).otherwise(x["start"])
        e = F.when(narrow, F.least(seg_end, middle + 0.5 * least)).otherwise(x["end"])
        return F.when((x["end"] > x["start"]) & (e > s), F.struct(s.alias("start"), e.alias("end"), x["mode"].alias("mode")))

    return F.when(usable, let(first, ends))


def merge_in_row(intervals: Column, gap: float) -> Column:
    """An array of intervals, sorted and joined where one starts at most ``gap`` after the end of those before."""
    nothing = F.expr(f"cast(array() as {INTERVALS})")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        join = F.coalesce(x["start"] <= last["end"] + gap, F.lit(False))
        return F.when(join, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    proper = F.transform(F.array_sort(intervals), lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    return F.filter(F.aggregate(proper, nothing, step), lambda x: x["end"] > x["start"])


# ---------------------------------------------------------------- text of chunks, subtitles


def _chunk_tokens(text: Column) -> Column:
    t = strip(text)
    chars = F.filter(F.regexp_extract_all(t, F.lit("(?s)."), 0), lambda c: strip(c) != "")
    return F.when(t.rlike(f"[{CJK}]"), chars).otherwise(F.regexp_extract_all(t, F.lit(r"(?U)[^\s\x1c-\x1f]+"), 0))


def _front(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+", "")


def without_overlap(before: Column, text: Column, most: int = 20, least: int = 4) -> Column:
    """``text`` without the tokens at its start that are the last ones of ``before``: the longest run of ``least`` to ``most``."""
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))

    def cut(glue):
        front = _front(text)
        return F.when(text.startswith(glue), _front(F.substr(text, F.length(glue) + 1))).when(front.startswith(glue), _front(F.substr(front, F.length(glue) + 1))).otherwise(text)

    def shared(x):
        a, b = x["a"], x["b"]
        # runs are only compared where their first tokens are the same
        begins = lambda k: F.coalesce(F.get(a, F.size(a) - k) == F.get(b, F.lit(0)), F.lit(False))
        k = F.try_element_at(F.filter(sizes, lambda k: (k <= F.size(a)) & (k <= F.size(b)) & begins(k) & (F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, k) == F.slice(b, 1, k))), F.lit(1))
        space = F.when(text.rlike(f"[{CJK}]") | before.rlike(f"[{CJK}]"), "").otherwise(" ")
        return let(k, lambda k: F.when(k.isNotNull(), F.call_function("array_join", F.slice(b, 1, k), space)))

    tokens = F.struct(_chunk_tokens(before).alias("a"), _chunk_tokens(text).alias("b"))
    return let(let(tokens, shared), lambda glue: F.when(glue.isNull(), text).otherwise(cut(glue)))


def merge_chunk_texts(texts: Column, most: int = 20, least: int = 4) -> Column:
    """Texts of overlapping chunks as one: each without what its predecessor ends with."""

    def step(acc, t):
        piece = F.when(F.size(acc) == 0, strip(t)).otherwise(strip(without_overlap(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t, most, least)))
        return F.when(F.coalesce(t, F.lit("")) == "", acc).otherwise(F.concat(acc, F.array(piece)))

    merged = F.aggregate(texts, F.array().cast("array<string>"), step)
    return strip(F.array_join(F.filter(merged, lambda t: t != ""), " "))


def stamped_segments(tokens: Column, chunk_start: Column, chunk_end: Column, joiner: str = "") -> Column:
    """Segments that time tokens such as ``<|1.5|>`` delimit, in seconds of the recording; other ``<|...|>`` tokens are skipped, and an open end is at most 30 s on."""
    nothing = F.expr("cast(array() as array<struct<start_sec: double, end_sec: double, text: string>>)")
    empty = F.array().cast("array<string>")

    def closed(acc, until):
        text = strip(F.array_join(acc["held"], joiner))
        found = F.struct((chunk_start + acc["since"]).cast("double").alias("start_sec"), (chunk_start + until).cast("double").alias("end_sec"), text.alias("text"))
        return F.when(acc["since"].isNotNull() & (text != ""), F.concat(acc["out"], F.array(found))).otherwise(acc["out"])

    def step(acc, t):
        stamp = F.regexp_extract(t, r"^<\|([0-9]+(?:\.[0-9]+)?)\|>$", 1)
        at = F.when(stamp != "", stamp.cast("double"))
        # text before the first stamp is not lost: it goes to the first segment
        held = F.when(acc["since"].isNull(), acc["held"]).otherwise(empty)
        timed = F.struct(at.alias("since"), held.alias("held"), closed(acc, at).alias("out"))
        kept = F.struct(acc["since"].alias("since"), F.concat(acc["held"], F.array(t)).alias("held"), acc["out"].alias("out"))
        return F.when(at.isNotNull(), timed).when(t.startswith("<|") & t.endswith("|>"), acc).otherwise(kept)

    start = F.struct(F.lit(None).cast("double").alias("since"), empty.alias("held"), nothing.alias("out"))
    return F.aggregate(tokens, start, step, lambda acc: closed(acc, F.least(chunk_end - chunk_start, acc["since"] + 30.0)))


def srt_time(sec: Column) -> Column:
    ms = F.bround(sec * 1000).cast("long")
    part = lambda unit, size: F.floor(ms / unit) % size
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60).cast("long"), part(1000, 60).cast("long"), (ms % 1000).cast("long"))


def srt(segments: Column) -> Column:
    """Subtitles of an array of struct<start_sec, end_sec, text>, in its order."""
    blocks = F.transform(segments, lambda s, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(srt_time(s["start_sec"]), F.lit(" --> "), srt_time(s["end_sec"])), s["text"], F.lit("")))
    return F.concat(strip(F.array_join(blocks, "\n")), F.lit("\n"))
