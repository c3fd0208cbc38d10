"""Byte-level BPE by pre-token, with the ids of the tokenizers library.

Merges never cross a pre-token, so a text's ids are those of its pre-tokens in turn.
``Encoder`` cuts a text into pre-tokens, takes ids of known ones from a table and merges
the rest.  The table starts with the whole-token strings: vocabulary strings proved, once
per process, to be one pre-token and to encode alone as themselves.

Merges are by ranks where they are proved to be the library's, else the library's own.
By ranks any two neighbours merge that make a vocabulary string, the least id first; the
library merges the pairs of its list in their order.  Both are the same where ids rise
with the list and the library merges every vocabulary string, alone, into itself.  For say
that both have merged alike so far and that x and y stand side by side, xy is in the
vocabulary, and the pair is not in the list.  Nothing has merged across the ends of xy, so
that the library does the same with xy alone and is left with x and y, not with xy.
"""

from __future__ import annotations

import json
import re
import struct
from itertools import islice

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Merged pre-tokens that a process remembers; beyond that it forgets those not asked for of late.
MEMO_ENTRIES = 500_000

_PATTERN = regex.compile(public_tokenizers.PATTERN)
# The same pattern spelt out for code points below U+0250, for the faster engine; words first, as no place matches two of the first three.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_LATIN = re.compile(f" ?[{_L}]++| ?[{_N}]++|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]++")
_BEYOND_LATIN = re.compile("[^\u0000-ɏ]")
#: Blocks in which the two libraries' Unicode tables differ; texts with these go to the tokenizers library whole.
CONTESTED = (
    (0x558, 0x58C), (0x88F, 0x88F), (0xC5C, 0xCDC), (0x208F, 0x209F), (0xA7CE, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DF1),
    (0x1246F, 0x12686), (0x16EA0, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x191D2),
    (0x1B123, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DFFF), (0x1E6C0, 0x1E6FF), (0x2B73A, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_CONTESTED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CONTESTED) + "]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memo(dict):
    """Pre-token to packed ids; has what it lacks merged and stays bounded.

    Once full, what it holds becomes the older half; what is asked for again moves back.
    """

    def __init__(self, fixed: dict[str, bytes], merge, limit: int):
        super().__init__(fixed)
        self.merge, self.limit, self.fixed, self.older = merge, limit // 2 + len(fixed), fixed, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.merge(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
                self.update(self.fixed)
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    ``path`` names a byte-level BPE file of the tokenizers library with the usual
    pre-token pattern and no normalizer; anything else raises ValueError.
    """

    def __init__(self, path: str = DEFAULT_VOCABULARY, memo_entries: int = MEMO_ENTRIES):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special strings that take their surroundings are not supported")
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self._spell = {b: c for c, b in alphabet.items()}
        self._ascii = {b: self._spell[b] for b in range(128)}
        self._model, self._code = self.library.model, "H" if self.dtype.itemsize == 2 else "I"
        self.token_bytes = [b""] * self.size
        for text, i in self.library.get_vocab(with_added_tokens=False).items():
            self.token_bytes[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.whole = self._prove()
        self._ranked = self._prove_ranks(spec["model"])
        self.memo = _Memo({text: self._packed([i]) for text, i in self.whole.items()}, self._merge, memo_entries)

    def _packed(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _merge(self, piece: str) -> bytes:
        """The merges of one pre-token; the library takes it in the vocabulary's stand-ins for bytes."""
        if self._ranked:
            ids = self._ranked.encode_ordinary(piece)
        else:
            spelt = piece.translate(self._ascii) if piece.isascii() else "".join(map(self._spell.__getitem__, piece.encode()))
            ids = [t.id for t in self._model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _prove_ranks(self, model: dict) -> tiktoken.Encoding | None:
        """Merges by ranks that take a string as one pre-token, if they are the library's."""
        known = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [known["".join(pair)] for pair in pairs]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or any(a >= b for a, b in zip(made, made[1:], strict=False)) or not known.keys() >= set(self._spell.values()):
            return None
        if any([t.id for t in self._model.tokenize(text)] != [i] for text, i in known.items()):
            return None
        return tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks={self.token_bytes[i]: i for i in known.values()}, special_tokens={})

    def _prove(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that the library encodes as that one id."""
        texts = []
        for i, raw in enumerate(self.token_bytes):
            try:
                texts.append((raw.decode(), i))
            except UnicodeDecodeError:
                continue
        texts = [(t, i) for t, i in texts if t and t not in self.special and self.pieces(t) == [t]]
        found = self.library.encode_batch_fast([t for t, _ in texts], add_special_tokens=False)
        return {t: i for (t, i), e in zip(texts, found, strict=True) if e.ids == [i]}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pre-tokens of a text without special strings or contested characters."""
        return (_PATTERN if _BEYOND_LATIN.search(text) else _LATIN).findall(text)

    def _parts(self, text: str):
        """The text cut at special strings; each part with its id if it is one."""
        if self._cut is None or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self._cut.split(text):
            if part:
                yield part, self.special.get(part)

    def packed(self, text: str) -> bytes:
        """The ids, ``dtype`` little-endian, one after another."""
        if _BEYOND_LATIN.search(text) and _CONTESTED.search(text):
            return self._packed(self._library_ids(text))
        look = self.memo.__getitem__
        return b"".join(self._packed([i]) if i is not None else b"".join(map(look, self.pieces(part))) for part, i in self._parts(text))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)

    def count(self, text: str) -> tuple[int, int]:
        """Ids of the text, and how many of them are whole-token pre-tokens counted without a merge."""
        if _BEYOND_LATIN.search(text) and _CONTESTED.search(text):
            return len(self._library_ids(text)), 0
        total = direct = 0
        width, look, whole = self.dtype.itemsize, self.memo.__getitem__, self.whole.__contains__
        for part, i in self._parts(text):
            if i is not None:
                total += 1
                continue
            pieces = self.pieces(part)
            known = sum(map(whole, pieces))
            direct += known
            total += known if known == len(pieces) else known + sum(len(look(p)) // width for p in pieces if not whole(p))
        return total, direct


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def rows(batch, *names: str, step: int = 256):
    """The named columns of an Arrow batch row by row, converted a few rows at a time."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for k in range(0, batch.num_rows, step):
        yield from zip(*(c.slice(k, step).to_pylist() for c in columns), strict=True)


def chunks(items, size: int):
    items = iter(items)
    while block := list(islice(items, size)):
        yield block
