"""Text normalisation, tokens, and buckets, as column expressions.

Null texts count as empty unless a function says otherwise.  White space is what Unicode
calls so and U+001C to U+001F, at the ends of texts and between tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
SPACE = r"(?U)[\s\x1c-\x1f]"

# ---- fixed values: number words
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|"
    "hundred|thousand|million|billion|trillion|point|and|minus|negative|oh|o"
)
NOT_A_NUMBER_ALONE = ("one", "point", "and", "minus", "negative", "oh", "o")
DIGIT_RUN = r"(?U)\b\d+(?:[.,:/-]\d+)*\b"
NUMBER_WORD_RUN = rf"(?iU)\b(?:{NUMBER_WORDS})(?:[-\s]+(?:{NUMBER_WORDS}))*\b"
# ---- fixed values: language codes, tags and Malay hints
LANGUAGE_ALIASES = {"automatic": "auto", "english": "en", "chinese": "zh", "mandarin": "zh", "zh-cn": "zh", "zh-tw": "zh"}
TAGS = {"tag_FIL": r"<FIL\s*/?>", "tag_EN": "<EN>", "tag_CN": "<CN>", "tag_MIX": "<MIX>", "tag_S": "<S>", "tag_Z": "<Z>"}
MALAY_HINTS = ("saya", "dan", "yang", "tidak", "untuk", "ini", "itu", "dengan", "anda", "terima", "kasih", "boleh", "akan")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def count_of(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_text(text), F.lit(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


# ------------------------------------------------------------------------- languages


def script_counts(text: Column | str) -> Column:
    """struct<zh_chars, en_chars>"""
    return F.struct(count_of(text, f"[{CJK}]").alias("zh_chars"), count_of(text, "[A-Za-z]").alias("en_chars"))


def script_bucket(text: Column | str) -> Column:
    """en, zh, mixed or unknown, by which letters are there."""
    zh, en = _text(text).rlike(f"[{CJK}]"), _text(text).rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def reference_bucket(text: Column | str) -> Column:
    """``script_bucket`` of the cleaned transcript, so that tags do not count."""
    return script_bucket(clean_transcript(text))


def language_code(raw: Column | str) -> Column:
    code = F.lower(strip(_text(raw)))
    aliases = F.create_map(*(F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv))
    return F.when(code == "", "auto").otherwise(F.coalesce(F.try_element_at(aliases, code), code))


def gold_language(raw: Column | str) -> Column:
    code = F.lower(_text(raw))
    return F.when(code.isin("en", "english"), "en").when(code.isin("zh", "chinese"), "zh").when(code.isin("mix", "mixed", "en+zh"), "mixed").otherwise(code)


def decode_language(text: Column | str, allowed: list[str], fallback: str) -> Column:
    """The language in which to decode a segment again: its bucket if allowed, the majority script of a mixed one, else the fallback or the first allowed."""
    bucket, n = script_bucket(text), script_counts(text)
    mixed = bucket == "mixed"
    out = F.when(bucket.isin(*allowed), bucket)
    if "zh" in allowed:
        out = out.when(mixed & (n["zh_chars"] > n["en_chars"]), "zh")
    if "en" in allowed:
        out = out.when(mixed & (n["en_chars"] > n["zh_chars"]), "en")
    return out.otherwise(fallback if fallback in allowed else allowed[0])


def malay_hints(text: Column | str) -> Column:
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-z']+"), 0)
    return F.size(F.filter(words, lambda w: w.isin(*MALAY_HINTS)))


def choose_candidate(en_text: Column | str, zh_text: Column | str, *, hints: bool = True) -> Column:
    """struct<text, chosen>: of two decodings, the one that keeps more scripts, with less Malay; ties go to Chinese.

    Without ``hints`` only the scripts count, Chinese for 3 instead of 4.
    """

    def score(t):
        s = F.when(_text(t).rlike(f"[{CJK}]"), 4 if hints else 3).otherwise(0) + F.when(_text(t).rlike("[A-Za-z]"), 2).otherwise(0)
        if hints:
            s = s - 2 * malay_hints(t) + F.least(F.lit(2), F.floor(F.length(strip(_text(t))) / 20).cast("int"))
        return s

    en_wins = (score(en_text) > score(zh_text)) | ((score(en_text) == score(zh_text)) & _text(en_text).rlike(f"[{CJK}]") & ~_text(zh_text).rlike(f"[{CJK}]"))
    return F.struct(F.when(en_wins, en_text).otherwise(zh_text).alias("text"), F.when(en_wins, "en_prompt").otherwise("zh_prompt").alias("chosen"))


def needs_retry(duration_sec: Column, text: Column | str, chosen: Column) -> Column:
    """The language for a second try of a long clip with a short text; null where none is needed."""
    return F.when((duration_sec > 12) & (F.length(_text(text)) < 20), F.when(chosen.contains("zh"), "zh").otherwise("en"))


def better_retry(text: Column, retried: Column) -> Column:
    return F.when(F.length(_text(retried)) > F.length(_text(text)), retried).otherwise(text)


# ----------------------------------------------------------- transcripts and their tokens


def fold_numbers(text: Column) -> Column:
    """Numbers in digits or words as `` num ``; single words that are often no number stay."""
    text = F.regexp_replace(text, DIGIT_RUN, " num ")
    gaps, runs = F.split(text, NUMBER_WORD_RUN, -1), F.regexp_extract_all(text, F.lit(NUMBER_WORD_RUN), 0)

    def folded(run):
        words = F.regexp_extract_all(F.lower(run), F.lit("[a-z]+"), 0)
        alone = (F.size(words) == 1) & F.element_at(words, 1).isin(*NOT_A_NUMBER_ALONE)
        return F.when((F.size(words) == 0) | alone | F.forall(words, lambda w: w == "and"), run).otherwise(" num ")

    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform(runs, folded), F.array(F.lit(""))), lambda gap, run: F.concat(gap, run)), "")
    return F.when(text.rlike(NUMBER_WORD_RUN), joined).otherwise(text)


def clean_transcript(text: Column | str, *, numbers: bool = False) -> Column:
    out = F.translate(F.regexp_replace(_text(text), "<[^>]+>", " "), "’`", "''")
    return collapse(fold_numbers(out) if numbers else out)


def mixed_words(text: Column | str, *, numbers: bool = False) -> Column:
    """Latin words and digits in lower case, and single Han characters."""
    return F.regexp_extract_all(F.lower(clean_transcript(text, numbers=numbers)), F.lit(f"[A-Za-z0-9]+|[{CJK}]"), 0)


def mixed_chars(text: Column | str, *, numbers: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(clean_transcript(text, numbers=numbers)), F.lit(f"[A-Za-z0-9{CJK}]"), 0)


def utterance_text(text: Column | str, *, lower: bool = True) -> Column:
    """White space collapsed and, for metrics, lower case."""
    return collapse(F.lower(_text(text)) if lower else _text(text))


def utterance_tokens(text: Column | str) -> Column:
    """Words; of a text without any space, its characters."""
    t = strip(_text(text))
    chars = F.regexp_extract_all(t, F.lit("(?s)."), 0)
    return F.filter(F.when(t.contains(" "), F.split(t, rf"{SPACE}+")).otherwise(chars), lambda w: strip(w) != "")


def words(text: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(_text(text), rf"{SPACE}+"), lambda w: w != "")


# -------------------------------------------------------------------------- labels, ids


def entity_label(raw: Column) -> Column:
    return F.upper(strip(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?i)^[BIES]-", "")))


def remapped_label(raw: Column, aliases: dict[str, str]) -> Column:
    """The normalised label under a map with normalised keys and values; unknown labels pass."""
    label = entity_label(raw)
    if not aliases:
        return label
    pairs = F.array(*(F.struct(entity_label(F.lit(k)).alias("k"), entity_label(F.lit(v)).alias("v")) for k, v in aliases.items()))
    found = F.filter(pairs, lambda p: (p["k"] == label) & (p["k"] != "") & (p["v"] != ""))
    return F.coalesce(F.try_element_at(found, F.lit(-1))["v"], label)


def names_of_ids(ids: Column, names: dict[int, str]) -> Column:
    """Names of an array of ids; UNKNOWN for the rest."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.lit("UNKNOWN")))


def speaker_session(utt_id: Column | str) -> Column:
    """struct<speaker_id, session_id> of ids like x_U0001_S0; nulls for others."""
    u, s = F.regexp_extract(_text(utt_id), r"(?U)_U(\d+)_S(\d+)$", 1), F.regexp_extract(_text(utt_id), r"(?U)_U(\d+)_S(\d+)$", 2)
    return F.struct(F.when(u != "", F.concat(F.lit("U"), u)).alias("speaker_id"), F.when(s != "", F.concat(F.lit("S"), s)).alias("session_id"))


def utterance_of_item(item_id: Column | str) -> Column:
    """The third of the parts of an item id that the first two underscores part."""
    parts = F.split(F.col(item_id) if isinstance(item_id, str) else item_id, "_", 3)
    return F.when(F.size(parts) == 3, parts[2])


def safe_name(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), "[^A-Za-z0-9._-]+", "_")


def rebased(path: Column, root: str, mount: str = "/workspace/") -> Column:
    """Paths under a container's mount as paths under ``root``; relative ones too."""
    return F.when(path.startswith(mount), F.concat(F.lit(root.rstrip("/") + "/"), F.substr(path, F.lit(len(mount) + 1)))).when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


# -------------------------------------------------------------------- previews and buckets


def preview(text: Column, chars: int = 200) -> Column:
    return F.substring(text, 1, chars)


def token_preview(tokens: Column, most: int = 40) -> Column:
    return F.concat(F.array_join(F.slice(tokens, 1, most), " "), F.when(F.size(tokens) > most, " ...").otherwise(""))


def ratio_mode(ratio: Column) -> Column:
    return F.when(ratio < 0.75, "under_generate_lt_0.75").when(ratio <= 1.25, "balanced_0.75_to_1.25").otherwise("over_generate_gt_1.25")


def length_bucket(text: Column | str) -> Column:
    n = F.size(words(text))
    return F.when(n <= 5, "1–5 words").when(n <= 10, "6–10 words").when(n <= 15, "11–15 words").otherwise("16+ words")


def tag_counts(text: Column | str) -> dict[str, Column]:
    return {name: count_of(text, pattern) for name, pattern in TAGS.items()}


def script_shares(text: Column | str) -> dict[str, Column]:
    n = script_counts(collapse(F.regexp_replace(_text(text), "<[^>]+>", " ")))
    total = F.greatest(F.lit(1), n["en_chars"] + n["zh_chars"])
    return {"en_chars": n["en_chars"], "zh_chars": n["zh_chars"], "en_char_share": n["en_chars"] / total, "zh_char_share": n["zh_chars"] / total}
