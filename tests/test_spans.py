import random

from pyspark.sql import functions as F

from veilscribe.functions import spans as S
from veilscribe.schemas import ENTITY, SPAN


def span(a, b, kind, text="", score=None, source="rule"):
    return (a, b, kind, text, score, source)


def merge_model(spans, gap, least):
    seen = {}
    for s in spans:
        a, b, kind = s[0] if s[0] is not None else -1, s[1] if s[1] is not None else -1, (s[2] or "").strip()
        if a >= 0 and b > a and kind and b - a >= least:
            seen.setdefault((a, b, kind), s[5])
    out = []
    for (a, b, kind), source in sorted(seen.items()):
        if out and out[-1][2] == kind and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), kind, out[-1][3])
        else:
            out.append((a, b, kind, source))
    return out


def test_merge_blocks(column):
    given = [span(0, 4, "A"), span(3, 8, "A"), span(5, 6, "B"), span(9, 12, "A")]
    text = F.lit("abcdefghijklmnop")
    got = column(lambda c: S.merge_adjacent(text, S.clean_spans(text, c, 1), 1), [given], f"array<{SPAN}>")[0]
    assert [(s["start"], s["end"], s["type"], s["text"]) for s in got] == [(0, 8, "A", "abcdefgh"), (5, 6, "B", "f"), (9, 12, "A", "jkl")]


def test_merge_is_that_of_the_model(column):
    draw = random.Random(5)
    rows = [[span(draw.choice([None, -1, *range(30)]), draw.randrange(0, 34), draw.choice(["A", "B", " A ", "", None]), source=draw.choice(["rule", "ner"])) for _ in range(draw.randrange(0, 9))] for _ in range(300)]
    text = F.lit("x" * 30)
    for gap, least in ((0, 1), (2, 3)):
        got = column(lambda c: S.merge_adjacent(text, S.clean_spans(text, c, least), gap), rows, f"array<{SPAN}>")  # noqa: B023
        assert [[(s["start"], s["end"], s["type"], s["source"]) for s in r] for r in got] == [merge_model(r, gap, least) for r in rows]
    assert column(lambda c: S.clean_spans(text, c, 1), [None], f"array<{SPAN}>") == [[]]


def test_redact(column):
    given = [[span(1, 3, "name"), span(2, 5, "ID")], [span(5, 99, None), span(0, 1, "X")], [span(9, 10, "X")], [], None]
    assert column(lambda c: S.redact(F.lit("abcdef"), c), given, f"array<{SPAN}>") == ["a[NAME]def", "[X]bcde[PII]", "abcdef", "abcdef", "abcdef"]
    assert column(lambda c: S.redact(c, F.lit(None)), [None], "string") == [""]


def test_locate(column):
    e = lambda t, a=None, b=None: ("T", t, a, b)
    rows = [[e("xx")] * 3, [e("yy", 3, 5), e("yy"), e("zz"), e(""), e(None)], [e("xx", 6, 8), e("xx")], None]
    got = column(lambda c: S.locate_entities(F.lit("xx yy xx"), c), rows, f"array<{ENTITY}>")
    assert [[(x["start_char"], x["end_char"]) for x in r] for r in got] == [[(0, 2), (6, 8), (0, 2)], [(3, 5), (3, 5), (None, None), (None, None), (None, None)], [(6, 8), (0, 2)], []]


def test_iou_and_containment(spark):
    r = spark.range(1).select(S.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)), S.iou(F.lit(0), F.lit(1), F.lit(1), F.lit(2)), S.containment(F.lit(" ab "), F.lit("abc")), S.containment(F.lit(" "), F.lit("abc"))).first()
    assert tuple(r) == (5 / 15, 0.0, True, False)


def greedy_model(gold, pred, threshold):
    pairs, used = [], set()
    for gi, (kind, text, gs, ge) in enumerate(gold):
        best, score = -1, 0.0
        for pi, (ps, pe, pk, pt, _, _) in enumerate(pred):
            if pi in used or (pk or "").upper() != (kind or "").upper():
                continue
            ok = False
            if None not in (gs, ge, ps, pe):
                lo, hi = max(ps, gs), min(pe, ge)
                o = (hi - lo) / (max(pe, ge) - min(ps, gs)) if lo < hi else 0.0
                ok = o >= threshold
                if ok and o > score:
                    best, score = pi, o
            a, b = (pt or "").strip(), (text or "").strip()
            if not ok and a and b and (a in b or b in a) and best == -1:
                best, score = pi, 0.5
        if best >= 0:
            used.add(best)
            pairs.append((gi, best, round(score, 9)))
    return pairs


def test_greedy_matching_is_that_of_the_model(spark):
    draw = random.Random(11)
    text = lambda: draw.choice(["ab", "abc", "zz", "", " ab "])
    rows = []
    for i in range(400):
        gold = [(draw.choice("AaB"), text(), *((None, None) if draw.random() < 0.2 else (x := draw.randrange(20), x + draw.randrange(1, 9)))) for _ in range(draw.randrange(0, 5))]
        pred = [((p := draw.randrange(20)), p + draw.randrange(1, 9), draw.choice("AaB"), text(), None, "rule") for _ in range(draw.randrange(0, 5))]
        rows.append((i, gold, pred))
    frame = spark.createDataFrame(rows, f"i int, g array<{ENTITY}>, p array<{SPAN}>")
    got = frame.orderBy("i").select(S.greedy_pairs(F.col("g"), F.col("p"), 0.5)).collect()
    assert [[(x["gi"], x["pi"], round(x["overlap"], 9)) for x in r[0]] for r in got] == [greedy_model(g, p, 0.5) for _, g, p in rows]
