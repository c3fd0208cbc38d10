"""Quality rules by tokeniser fertility.

A public vocabulary that was fitted on clean text says how like it a document is:
characters per token, the share of tokens that are fragments of characters (byte
fallback), and the entropy of the tokens.  Each language or script has bands for the
three; a document outside one of its bands is rejected.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.store import free, tidy

MULTI_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a document's measures must lie in; ``vocabulary`` is ``english`` or ``multi``."""

    vocabulary: str
    least_chars: float
    most_chars: float
    most_fragments: float
    least_entropy: float


#: Entropy that is enough for a text of any length, in bits; short texts need ``least_entropy`` of what they could have.
ENOUGH_ENTROPY = 4.5

#: By language code, then by script, then ``other``.  Characters per token: prose runs at 2 to 6 in an alphabet and at
#: about 1 in Han or kana; encoded data, symbol soup and random letters lie below, runs of one long string above.
#: Entropy: prose has over 0.6 of what as many tokens could have, loops of a few tokens far less.
BANDS = {
    "en": Band("english", 2.0, 8.0, 0.20, 0.35),
    "fr": Band("multi", 2.0, 8.0, 0.20, 0.35),
    "de": Band("multi", 2.0, 8.0, 0.20, 0.35),
    "es": Band("multi", 2.0, 8.0, 0.20, 0.35),
    "latin": Band("multi", 1.3, 8.0, 0.30, 0.35),
    "greek": Band("multi", 0.7, 6.0, 0.60, 0.35),
    "cyrillic": Band("multi", 0.9, 8.0, 0.50, 0.35),
    "arabic": Band("multi", 0.7, 6.0, 0.60, 0.35),
    "hebrew": Band("multi", 0.5, 6.0, 0.70, 0.35),
    "indic": Band("multi", 0.3, 4.0, 0.95, 0.30),
    "thai": Band("multi", 0.3, 4.0, 0.95, 0.30),
    "hangul": Band("multi", 0.3, 4.0, 0.95, 0.35),
    "kana": Band("multi", 0.3, 4.0, 0.95, 0.35),
    "han": Band("multi", 0.3, 4.0, 0.95, 0.35),
    "other": Band("multi", 0.2, 8.0, 1.00, 0.30),
}
_RANGES = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿", "indic": "ऀ-෿", "thai": "฀-๿", "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿\U00020000-\U0002ebef",
}
_SCRIPTS = {k: re.compile(f"[{v}]+") for k, v in _RANGES.items()}
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def script_of(text: str) -> str:
    """The script of most letters; ``other`` without letters.  Japanese counts as kana if it has a tenth of it."""
    if not _BEYOND_LATIN.search(text):
        return "latin" if _SCRIPTS["latin"].search(text) else "other"
    counts = {k: sum(map(len, p.findall(text))) for k, p in _SCRIPTS.items()}
    if counts["kana"] * 10 >= counts["han"] + counts["kana"] > 0:
        counts["kana"] += counts.pop("han")
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class _Vocabulary:
    """Ids of a text and, by id, whether the token alone is no whole characters."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ids = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.own = {"disallowed_special": ()}
            raw = {i: b for b, i in ranks.items()}
        else:
            encoder = vocab.encoder(path)
            self.ids, self.own, raw = encoder.ids, {}, dict(enumerate(encoder.token_bytes))
        self.fragment = np.zeros(max(raw) + 1, bool)
        for i, b in raw.items():
            try:
                b.decode()
            except UnicodeDecodeError:
                self.fragment[i] = True

    def measure(self, text: str) -> tuple[int, float | None, float | None, float | None]:
        """tokens, characters per token, share of fragments, entropy; the last three are None without tokens."""
        ids = self.ids(text, **self.own)
        n = len(ids)
        if not n:
            return 0, None, None, None
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
        return n, len(text) / n, float(self.fragment[ids].mean()), entropy


@lru_cache
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def outside(band: Band, n: int, chars: float | None, fragments: float | None, entropy: float | None) -> str | None:
    """Which measure is out of its band, the first of them; None if all are in or there are no tokens."""
    if not n:
        return None
    if not band.least_chars <= chars <= band.most_chars:
        return "chars_per_token"
    if fragments > band.most_fragments:
        return "byte_fallback"
    if n > 1 and entropy < min(band.least_entropy * np.log2(n), ENOUGH_ENTROPY):
        return "entropy"
    return None


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)] if "\n" in text else ()
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[str]) -> int:
    """Words in windows of three words that the text has twice or more."""
    if len(words) < 4:
        return 0
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(numbers) == len(words):
        return 0
    at, size = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), len(numbers)
    pair = at[:-1] * size + at[1:]
    if size >= 1 << 20:  # three numbers no longer go into 63 bits
        pair, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), max(size, len(words))
    windows = pair[:-1] * size + at[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_fallback double, entropy double, band string, reason string"


def result_names(carried) -> list[str]:
    """What the results beside the carried columns are called."""
    return free(carried, *(x.split()[0] for x in MEASURES.split(", ")))


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", *, bands: dict[str, Band] | None = None, english: str = vocab.DEFAULT_VOCABULARY, multi: str = MULTI_VOCABULARY,
    least_words: int = 50, most_repeated: int = 50, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: its id, the base statistics, base_failed, kept, the measures, the band used and a reason if rejected.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent
    of them in repeated windows of three.  kept: not base_failed and within the band.  A
    document with no band for its language (a null one, too) is judged by its script.
    A null text is an empty one: no words, so base_failed, and null measures.  Ids may be
    null or repeat; each row is judged by itself.  ``carry`` names columns of ``docs``
    to keep; a result named like one of them has an underscore after it.  An empty table
    gives no row.  One narrow pass over whole texts, without a shuffle.
    """
    bands = BANDS if bands is None else bands
    lang = F.col(lang_col) if lang_col else F.lit(None)
    kept = [id_col, *(c for c in carry if c != id_col)]
    code_name, text_name = free(kept, "lang", "text")
    source = docs.select(*kept, lang.cast("string").alias(code_name), F.col(text_col).alias(text_name))
    results = result_names(kept)
    kinds = [*(source.schema[c].dataType.simpleString() for c in kept), *(x.split()[1] for x in MEASURES.split(", "))]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip([*kept, *results], kinds, strict=True))
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.string()] * 2

    def run(batches):
        known = {"english": _vocabulary(english), "multi": _vocabulary(multi)}
        for batch in batches:
            out = []
            for code, text in vocab.rows(batch, code_name, text_name):
                text = text or ""
                stats = base_stats(text)
                name = code if code in bands else script_of(text)
                band = bands.get(name) or bands["other"]
                measures = known[band.vocabulary].measure(text)
                failed = stats[0] < least_words or 100 * stats[4] > most_repeated * stats[0]
                reason = ("words" if stats[0] < least_words else "repetition") if failed else outside(band, *measures)
                out.append((*stats, failed, reason is None, *measures, name, reason))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [*kept, *results])

    return source.mapInArrow(tidy(run), schema)
