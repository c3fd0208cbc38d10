import re

import pytest
from pyspark.sql import functions as F

from veilscribe.functions import text as T


def test_script_bucket(column):
    texts = ["hi 你", "123", "你", "hi", "", None]
    assert column(T.script_bucket, texts, "string") == ["mixed", "unknown", "zh", "en", "unknown", "unknown"]


def test_number_folding(column):
    texts = ["one dog", "twenty one", "and and", "3.50", "and one", "Sixteen-hundred Oh", "o", "x12", "1,000/2 and", None]
    folded = column(lambda c: T.fold_numbers(F.coalesce(c, F.lit(""))), texts, "string")
    assert folded == ["one dog", " num ", "and and", " num ", " num ", " num ", "o", "x12", " num  and", ""]


def test_clean_transcript_and_tokens(column):
    texts = ["<FIL/>It’s `ok`　 你好\x1cA", None, "", "É1b"]
    assert column(T.clean_transcript, texts, "string") == ["It's 'ok' 你好 A", "", "", "É1b"]
    assert column(T.mixed_words, texts, "string") == [["it", "s", "ok", "你", "好", "a"], [], [], ["1b"]]
    assert column(T.mixed_chars, texts, "string")[3] == ["1", "b"]


def test_utterance_tokens(column):
    assert column(T.utterance_tokens, ["你好", " a b ", "", None, "ab"], "string") == [["你", "好"], ["a", "b"], [], [], ["a", "b"]]


@pytest.mark.parametrize(("raw", "label"), [("B-per", "PER"), ("i-LOC ", "LOC"), ("ORG", "ORG"), (None, ""), ("S-x", "X")])
def test_entity_label(column, raw, label):
    assert column(T.entity_label, [raw], "string") == [label]


def test_remapped_label(column):
    assert column(lambda c: T.remapped_label(c, {"per": "B-name", "LOC": ""}), ["B-PER", "LOC", "gpe"], "string") == ["NAME", "LOC", "GPE"]


def test_codes_and_ids(column):
    assert column(T.language_code, [None, " English", "ZH-CN", "fr"], "string") == ["auto", "en", "zh", "fr"]
    assert column(T.gold_language, ["EN+ZH", "mix", "chinese", None], "string") == ["mixed", "mixed", "zh", ""]
    assert [tuple(r) for r in column(T.speaker_session, ["a_U12_S3", "a_U12", None], "string")] == [("U12", "S3"), (None, None), (None, None)]
    assert column(T.utterance_of_item, ["cs_test_a_b", "a_b", None], "string") == ["a_b", None, None]


def test_decode_language(column):
    assert column(lambda c: T.decode_language(c, ["zh", "en"], "en"), ["你好hi!", "你好吗hi", "你hey", "1", "hi"], "string") == ["en", "zh", "en", "en", "en"]
    assert column(lambda c: T.decode_language(c, ["zh"], "fr"), ["hi"], "string") == ["zh"]


def test_choose_candidate(spark):
    rows = [("hello", "你好"), ("saya dan", "x"), ("x" * 45, "yy"), ("a", "a"), ("", "")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, en string, zh string")
    got = [r[0] for r in frame.orderBy("i").select(T.choose_candidate("en", "zh")["chosen"]).collect()]
    assert got == ["zh_prompt", "zh_prompt", "en_prompt", "zh_prompt", "zh_prompt"]


def test_previews_and_buckets(column):
    assert column(T.length_bucket, ["a " * n for n in (0, 5, 6, 10, 11, 15, 16)], "string") == ["1–5 words"] * 2 + ["6–10 words"] * 2 + ["11–15 words"] * 2 + ["16+ words"]
    assert column(T.ratio_mode, [0.74, 0.75, 1.25, 1.26], "double") == ["under_generate_lt_0.75", "balanced_0.75_to_1.25", "balanced_0.75_to_1.25", "over_generate_gt_1.25"]
    assert column(lambda c: T.token_preview(c, 2), [["a", "b"], ["a", "b", "c"]], "array<string>") == ["a b", "a b ..."]
    assert column(lambda c: T.rebased(c, "/r"), ["/workspace/a", "/x", "y"], "string") == ["/r/a", "/x", "/r/y"]


def test_tags(column):
    text = "<FIL/><FIL ><EN>你<Z>ab"
    assert [column(c, [text], "string")[0] for c in (lambda v: T.tag_counts(v)["tag_FIL"], lambda v: T.tag_counts(v)["tag_Z"], lambda v: T.script_shares(v)["en_char_share"])] == [2, 1, 2 / 3]


def test_white_space_is_that_of_python(column):
    texts = ["".join(chr(c) for c in range(32)) + "a  b　\x85", "\x1f x \x1c"]
    assert column(T.collapse, texts, "string") == [" ".join(t.split()) for t in texts] or [re.sub(r"[\x00-\x08\x0e-\x1b]", "", t) for t in texts]
