"""Queries without SQL, held against brute force over whole tables."""

import difflib
import os
import re
from collections import Counter

import numpy as np
import pytest

from veilscribe import catalogue
from veilscribe.operators import rules

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def pairs(spark):
    """conv_id, turn, reference and transcript: user turns with the turn after them."""
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        if r["conv_id"] is not None and r["turn"] is not None:
            key, value = (r["conv_id"], r["turn"]), (r["role"], r["text"] or "")
            turns[key] = min(turns.get(key, value), value)
    ordered = sorted(turns)
    return [(*a, turns[a][1], turns[b][1]) for a, b in zip(ordered, ordered[1:], strict=False) if a[0] == b[0] and turns[a][0] == "user"]


def edits(a, b):
    """The edit distance by rows of the table."""
    numbers = {}
    a, b = (np.array([numbers.setdefault(t, len(numbers)) for t in x], np.int64) for x in (a, b))
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for token in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != token))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def test_corpus_rates(spark):
    def tokens(text, pattern):
        return re.findall(pattern, " ".join(re.sub(r"<[^>]+>", " ", text).replace("’", "'").replace("`", "'").split()).lower())

    found = {r["lang_bucket"]: r for r in catalogue.QUERIES["q_corpus_wer"](spark, DATA).collect()}
    buckets = {}
    for _, _, ref, hyp in pairs(spark):
        zh, en = re.search("[一-鿿]", ref), re.search("[A-Za-z]", ref)
        for bucket in ("mixed" if zh and en else "zh" if zh else "en" if en else "unknown", "ALL"):
            buckets.setdefault(bucket, []).append((ref, hyp))
    assert set(found) == set(buckets) and len(buckets) > 1
    for bucket, texts in buckets.items():
        for name, size, pattern in (("wer", "ref_word_tokens", "[A-Za-z0-9]+|[一-鿿]"), ("cer", "ref_chars", "[A-Za-z0-9一-鿿]")):
            a, b = ([t for pair in texts for t in tokens(pair[k], pattern)] for k in (0, 1))
            assert found[bucket][size] == len(a) and found[bucket][name] == (pytest.approx(edits(a, b) / len(a), abs=1e-6) if a else None)
        assert found[bucket]["num_conversations"] == len(texts)


def test_substitution_pairs(spark):
    counts = Counter()
    for _, _, ref, hyp in pairs(spark):
        a, b = ref.lower().split(), hyp.lower().split()
        for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
            if kind == "replace":
                counts.update((x, y) for x, y in zip(a[i:j], b[k:m], strict=False) if x != y)
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:15]
    found = sorted(map(tuple, catalogue.QUERIES["q_substitution_pairs"](spark, DATA).select("rank", "ref", "pred", "n").collect()))
    assert found == [(k + 1, *words, n) for k, (words, n) in enumerate(expected)]


def python_pattern(pattern):
    prefix, rest = re.match(r"(\(\?i?U\))(.*)", pattern, re.S).groups()
    return re.compile(rest, re.IGNORECASE if "i" in prefix else 0)


def spans_of(text):
    """The merged spans of all rules, from their patterns in Python's engine."""
    found = []
    for rule in rules.RULES:
        for m in python_pattern(rule.pattern).finditer(text):
            start, value = m.start(rule.group), m[rule.group]
            if rule.kind == "ID":
                front = re.sub(f"^{rules.ID_EDGE}", "", value)
                body = python_pattern(rules.ID_FILLER).sub("", front)
                start, value = start + len(value) - len(body), re.sub(rf"{rules.ID_EDGE}\Z", "", body)
                if not re.search(rules.ID_DIGIT, value):
                    continue
            if len(value) >= 2:
                found.append((start, start + len(value), rule.kind))
    merged = []
    for start, end, kind in sorted(set(found)):
        if merged and merged[-1][2] == kind and start <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    return [(a, b, kind, text[a:b]) for a, b, kind in merged]


def test_all_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = sorted(map(tuple, catalogue.QUERIES["q_all_rules"](spark, DATA).collect()))
    assert found == sorted((i, *s) for i, t in texts.items() for s in spans_of(t or "")) and len(found) > 10
