import random
import re

import pytest
from pyspark.sql import functions as F

from veilscribe.functions.matches import find_spans
from veilscribe.operators.detect import detect, gazetteer, llm_spans
from veilscribe.operators.rules import RULES, rule_spans

CASES = [
    ("my phone number is 9123 4567 or +65 9123-4567.", "PHONE", [(19, 28), (32, 45)]),
    ("电话是九八一零 和 九三四五，六六七七", "PHONE", [(3, 7), (10, 19)]),
    ("nine one three two five six seven eight ok", "PHONE", [(0, 39)]),
    ("nric S1234567A and xS1234567A, t0123456j", "ID", [(5, 14), (31, 40)]),
    ("我的ID是FAKE-ID-七七八八，员工编号是 STAFF-ID-5521", "ID", [(5, 17), (24, 37)]),
    ("我住在绿园路大牌六六三 南京路", "ADDRESS", [(0, 15)]),
    ("大牌三零一，门牌二一，中山路, Green View Road", "ADDRESS", [(0, 31)]),
    ("mail a.b+c@x.co.sg 😀 after emoji 99999999", "PHONE", [(33, 41)]),
    ("mail a.b+c@x.co.sg 😀 after emoji 99999999", "EMAIL", [(5, 18)]),
    ("全角１２３４５６７８９ fullwidth 9123　4567　88", "PHONE", [(2, 11), (22, 34)]),
    ("phone 9123 café 12 Straße Road 7", "PHONE", [(6, 10)]),
    ("phone 9123 café 12 Straße Road 7", "ADDRESS", [(6, 32)]),
]


@pytest.mark.parametrize(("text", "kind", "expected"), CASES)
def test_worked_cases(column, text, kind, expected):
    spans = column(lambda c: rule_spans(c, {"generic_id": True}), [text], "string")[0]
    found = {(s["start"], s["end"]) for s in spans if s["type"] == kind}
    assert set(expected) <= found
    assert all(text[s["start"] : s["end"]] == s["text"] for s in spans)


def test_ids_lose_fillers_and_need_digits(column):
    text = "reference ID is 9. application ID 12, STAFF id number should be AB-12, staff id is none"
    spans = column(lambda c: rule_spans(c, {"id_number": True}), [text], "string")[0]
    assert {(s["start"], s["end"]) for s in spans if s["type"] == "ID"} == {(16, 17), (34, 36), (64, 69)}


def test_toggles(column):
    assert column(lambda c: rule_spans(c, {}), ["staff id 12345"], "string")[0] == []
    off = {r.name: False for r in RULES}
    assert column(lambda c: rule_spans(c, off), ["a@b.co"], "string")[0] == []
    assert column(lambda c: rule_spans(c, {}), [None, ""], "string") == [[], []]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.name}-{r.group}-{len(r.pattern)}")
def test_matches_are_those_of_re(column, rule):
    prefix, pattern = re.match(r"(\(\?i?U\))(.*)", rule.pattern, re.S).groups()
    own = re.compile(pattern, re.IGNORECASE if "i" in prefix else 0)
    draw = random.Random(rule.pattern)
    parts = ["1", "23", "4567", "+65 ", "-", " ", "，", "a", "S", "T1234567", "@x.co", "ab@c.de", "九八一零", "二", "电话", "是", "南京Residence", "大牌", "路", "南京", "Road", "Street 5", "Block 12 ", "phone", "id", " is ", "staff ", "number", "Singapore ", "609690", "nine ", "one two ", "员工编号", "😀", "１２", "　", "é", "."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(250)]
    found = column(lambda c: find_spans(c, rule.pattern, rule.kind, group=rule.group, hints=rule.hints), texts, "string")
    assert [[(s["start"], s["end"], s["text"]) for s in x] for x in found] == [[(m.start(rule.group), m.end(rule.group), m[rule.group]) for m in own.finditer(t)] for t in texts]


def test_detectors_in_order(spark):
    rows = spark.createDataFrame([("a", "Ann a@b.co", '[{"pii_type": "NAME", "text": "Ann"}]'), ("b", " ", None), ("c", None, "x")], "id string, text string, answer string")
    found = detect(rows, model=gazetteer({"Ann": "B-PER", "a@b.co": "EMAIL"}), aliases={"PER": "name"}, responses="answer", merge_gap=0, min_chars=1)
    got = {r["id"]: [(s["start"], s["end"], s["type"], s["source"]) for s in r["spans"]] for r in found.collect()}
    assert got == {"a": [(0, 3, "NAME", "ner"), (4, 10, "EMAIL", "rule")], "b": [], "c": []}


def test_model_threshold_keeps_null_scores(spark):
    def make():
        return lambda t: [{"entity_group": "X", "start": 0, "end": 1, "score": 0.2}, {"entity": "Y", "start": 1, "end": 2}, {"entity": "Z", "start": 2, "end": 2, "score": 1.0}, {"entity": "W", "start": None, "end": 2}]

    found = detect(spark.createDataFrame([("abc",)], "text string"), rules=False, model=make, threshold=0.5, merge_gap=0, min_chars=1).first()["spans"]
    assert [(s["type"], s["score"]) for s in found] == [("Y", None)]


def test_llm_answers(spark):
    text = "Ann met Ann at 5 Road"
    two = '[{"pii_type": "name", "text": "Ann"}, {"pii_type": "NAME", "text": " Ann "}, {"pii_type": "NAME", "text": "Ann"}, {"pii_type": "CITY", "text": "Road"}, 3, {"text": "x"}]'
    answers = [two, f"Here: {two}.", '{"a": [1]}', "no", None, "[]", "[1, 2"]
    frame = spark.createDataFrame([(i, text, a) for i, a in enumerate(answers)], "i int, t string, a string")
    got = [[(s["start"], s["end"], s["type"]) for s in r[0]] for r in frame.orderBy("i").select(llm_spans(F.col("t"), F.col("a"))).collect()]
    both = [(0, 3, "NAME"), (8, 11, "NAME"), (0, 3, "NAME")]
    assert got == [both, both, [], [], [], [], []]


def test_a_language_model_is_asked(spark):
    def make():
        def ask(instructions, text):
            if "broken" in text:
                raise OSError("no connection")
            assert "JSON" in instructions
            return f'[{{"pii_type": "NAME", "text": "{text.split()[0]}"}}]'

        return ask

    rows = spark.createDataFrame([("a", "Ann met Ann"), ("b", "broken line a@b.co"), ("c", "  "), ("d", None), ("e", "Bo")], "id string, text string")
    found = {r["id"]: [(s["start"], s["end"], s["type"], s["source"]) for s in r["spans"]] for r in detect(rows, llm=make, merge_gap=0, min_chars=1).collect()}
    assert found == {"a": [(0, 3, "NAME", "llm")], "b": [(12, 18, "EMAIL", "rule")], "c": [], "d": [], "e": [(0, 2, "NAME", "llm")]}
