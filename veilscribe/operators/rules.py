"""Detection rules: a table of patterns, each with its type, toggle and captured group.

Patterns are in the JVM's syntax; ``(?U)`` makes ``\\d``, ``\\s``, ``\\w`` and ``\\b`` those of
Unicode, ``(?iU)`` folds case by Unicode too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscribe.functions.matches import find_spans, make_span, no_spans
from veilscribe.functions.spans import clean_spans, merge_adjacent

# ---- fixed values: the patterns of the rules
ZH_DIGIT = "[零一二三四五六七八九〇○]"
EN_DIGIT = "(?:zero|one|two|three|four|five|six|seven|eight|nine)"
ID_CHARS = "A-Za-z0-9零一二三四五六七八九〇○"
ID_DIGIT = "[0-9零一二三四五六七八九〇○]"
ID_SEPARATOR = r"(?:[\s,，、:：/_-]+)"
ID_NUMBER = f"(?=[{ID_CHARS}]*{ID_DIGIT})[{ID_CHARS}]+"
ID_VALUE = f"(?:[{ID_CHARS}]+{ID_SEPARATOR}){{0,2}}{ID_NUMBER}(?:{ID_SEPARATOR}{ID_NUMBER})*"
ROAD_END = r"(?:Road|Street|Avenue|Drive|Lane|View\s+Road)"
ROAD = r"(?:Road|Street|Avenue|Drive|Lane|Way|Crescent|Place|Boulevard|View\s+Road|Grove\s+Road)"

PHONE = r"(?<!\d)(?:\+?\d[\d\-\s]{6,}\d)(?!\d)"
ZH_PHONE = rf"(?:{ZH_DIGIT}{{4}}[，、,\s]{ZH_DIGIT}{{4}})|(?:{ZH_DIGIT}{{8,}})"
EN_SPOKEN_PHONE = rf"(?:{EN_DIGIT}(?:\s+{EN_DIGIT}){{7,}})"
EN_PARTIAL_PHONE = r"(?:phone|number|call|dial|contact|hp|handphone)[\s:]*(\d{4,})"
ZH_PARTIAL_PHONE = rf"(?:电话|手机|联系|号码|拨打)[是为：:]*\s*({ZH_DIGIT}{{3,}})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ZH_ADDRESS = (
    rf"(?:[一-鿿]{{0,6}})?大牌{ZH_DIGIT}{{2,}}(?:[，、,\s]*门牌{ZH_DIGIT}+)?(?:[，、,\s]*[一-鿿]{{2,6}}(?:路|街|道|桥))?(?:[，、,\s]+[A-Za-z][\w\s]*?{ROAD_END})?"
    rf"|[一-鿿]{{2,6}}(?:路|街|道|园|苑|花园|公寓|Residence)(?:[，、,.\s]*大牌{ZH_DIGIT}{{2,}})?"
)
EN_ADDRESS = (
    rf"(?:Block|Blk)\s+\d+[\s,]*[\w\s]*?{ROAD}"
    rf"|\d{{1,4}}\s+[\w\s]*?{ROAD}(?:\s+\d{{1,4}})?"
    rf"|[\w]+(?:\s+[\w]+){{0,1}}\s+{ROAD}\s+\d{{1,4}}"
)
EN_ID = (
    r"(?:(?:(?:reference|ref|application|app|booking|tracking|ticket|case|staff|employee|system|record)\s+id(?:\s+number)?)"
    r"|(?:id(?:\s+number)?)"
    r"|(?:(?:employee|staff|application|reference|tracking|booking|case|ticket|record)\s+number))"
    rf"\s*(?:is|was|=|:|should\s+be)?\s*((?!(?:is|was|should|be)\b){ID_VALUE})"
)
ZH_ID = rf"(?:身份证(?:号码)?|证件(?:号|号码)?|员工编号|工号|申请编号|参考编号|订单编号|预约编号|系统编号|ID)\s*(?:是|为|:|：)?\s*({ID_VALUE})"
NRIC = r"(?<![A-Za-z])[STFGM]\d{7}[A-Za-z](?![A-Za-z])"
POSTAL = r"(?:Singapore\s*|S)\d{6}(?!\d)"
POSTAL_AFTER_ROAD = rf"{ROAD}(?:\s+\d{{1,4}})?[,\s]+(\d{{6}})(?!\d)"
ID_EDGE = r"[ \t,，、:：/_-]+"
ID_FILLER = r"(?iU)^(?:is|was|be|should\s+be)\s+"


@dataclass(frozen=True)
class Rule:
    """``name`` switches the rule; ``instead`` is another name that does, where the first is not given.  ``hints`` are those of ``find_spans``."""

    name: str
    kind: str
    pattern: str
    group: int = 0
    on: bool = True
    instead: str | None = None
    hints: tuple[str, ...] = ()

    def enabled(self, toggles: dict[str, bool]) -> bool:
        return bool(toggles.get(self.name, toggles.get(self.instead, self.on) if self.instead else self.on))


RULES = (
    Rule("phone", "PHONE", f"(?U){PHONE}"),
    Rule("zh_phone", "PHONE", f"(?U){ZH_PHONE}", hints=(f"{ZH_DIGIT}{{4}}",)),
    Rule("en_spoken_phone", "PHONE", f"(?iU){EN_SPOKEN_PHONE}"),
    Rule("partial_phone", "PHONE", f"(?iU){EN_PARTIAL_PHONE}", group=1, hints=(r"(?U)\d{4}",)),
    Rule("partial_phone", "PHONE", f"(?U){ZH_PARTIAL_PHONE}", group=1, hints=(f"{ZH_DIGIT}{{3}}",)),
    Rule("email", "EMAIL", f"(?U){EMAIL}", hints=("@",)),
    Rule("address", "ADDRESS", f"(?U){ZH_ADDRESS}", hints=("[大路街道园苑公]|Residence",)),
    Rule("address", "ADDRESS", f"(?iU){EN_ADDRESS}", hints=(r"(?U)\d", f"(?iU){ROAD}")),
    Rule("generic_id", "ID", f"(?iU){EN_ID}", group=1, on=False, instead="id_number", hints=(ID_DIGIT, "(?iU)id|number")),
    Rule("generic_id", "ID", f"(?iU){ZH_ID}", group=1, on=False, instead="id_number", hints=(ID_DIGIT, "(?iU)id|[证号]")),
    Rule("nric", "ID", f"(?iU){NRIC}", hints=(r"(?U)\d{7}",)),
    Rule("postal_code", "ADDRESS", f"(?iU){POSTAL}", hints=(r"(?U)\d{6}",)),
    Rule("postal_code", "ADDRESS", f"(?iU){POSTAL_AFTER_ROAD}", group=1, hints=(r"(?U)\d{6}", f"(?iU){ROAD}")),
)


def trimmed_ids(spans: Column) -> Column:
    """ID matches without separators and filler words at their ends; those without a digit go."""

    def trim(s):
        front = F.regexp_replace(s["text"], f"^{ID_EDGE}", "")
        start = s["start"] + F.length(s["text"]) - F.length(front)
        body = F.regexp_replace(front, ID_FILLER, "")
        start = start + F.length(front) - F.length(body)
        text = F.regexp_replace(body, rf"{ID_EDGE}\z", "")
        return make_span(start, start + F.length(text), s["type"], text, s["source"])

    return F.filter(F.transform(spans, trim), lambda s: s["text"].rlike(ID_DIGIT))


def rule_spans(text: Column, toggles: dict[str, bool] | None = None) -> Column:
    """Spans of all enabled rules in the order of their places; a null text has none."""
    text, found = F.coalesce(text, F.lit("")), []
    for rule in RULES:
        if rule.enabled(toggles or {}):
            spans = find_spans(text, rule.pattern, rule.kind, group=rule.group, hints=rule.hints)
            found.append(trimmed_ids(spans) if rule.kind == "ID" else spans)
    if not found:
        return no_spans()
    numbered = F.transform(F.concat(*found), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def detect_by_rules(segments: DataFrame, toggles: dict[str, bool] | None = None, *, text_col: str = "text", spans_col: str = "spans", merge_gap: int = 1, min_chars: int = 2) -> DataFrame:
    """``segments`` with the merged spans of the rules; one narrow stage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.col(f"{spans_col}__raw")
    out = segments.withColumn(f"{spans_col}__raw", rule_spans(F.col(text_col), toggles))
    return out.withColumn(spans_col, merge_adjacent(text, clean_spans(text, raw, min_chars), merge_gap)).drop(f"{spans_col}__raw")
