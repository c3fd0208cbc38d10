import random

import pytest
from pyspark.sql import functions as F

from veilscribe.functions import times as T
from veilscribe.operators.masking import MaskOptions, mask_wave, masked_name, merge_intervals, read_wave, write_wave
from veilscribe.schemas import WORD


def pairs(rows):
    return [tuple(round(x, 6) for x in r) for r in rows]


def test_clip_windows(column):
    got = column(lambda c: T.clip_windows(F.lit(0.0), c, 12.0), [30.0, 12.0, 0.0, None], "double")
    assert [pairs(r) for r in got] == [[(0, 12), (12, 24), (24, 30)], [(0, 12)], [], []]
    assert pairs(column(lambda c: T.clip_windows(F.lit(1.0), c, 0.0), [30.0], "double")[0]) == [(1, 30)]


def test_chunk_ranges(column):
    got = column(lambda c: T.chunk_ranges(c, 20.0, 2.0, 1.5), [50.0, 1.0, 20.0, 0.0, 38.5], "double")
    assert [pairs(r) for r in got] == [[(0, 20), (18, 38), (36, 50)], [], [(0, 20)], [], [(0, 20), (18, 38), (36, 38.5)]]


def test_proportional_slices(column):
    assert column(lambda c: T.proportional_slices(c, F.lit(3)), ["abcdefg", "", "a"], "string") == [["ab", "cde", "fg"], ["", "", ""], ["a", "a", "a"]]
    assert column(lambda c: T.proportional_slices(c, F.lit(1)), [" ab "], "string") == [["ab"]]


def test_merge_in_row_and_relational(spark, column):
    draw = random.Random(3)
    rows = [[(a := round(draw.random() * 50, 2), round(a + draw.random() * 4, 2)) for _ in range(draw.randrange(0, 12))] for _ in range(120)]

    def model(x):
        out = []
        for a, b in sorted(x):
            if out and a <= out[-1][1] + 0.5:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return [(a, b) for a, b in out if b > a]

    assert [pairs(r) for r in column(lambda c: T.merge_in_row(c, 0.5), rows, T.INTERVALS)] == [model(r) for r in rows]
    flat = spark.createDataFrame([(i, *x) for i, r in enumerate(rows) for x in r], "k int, start double, end double")
    for bucket in (None, 7.0):
        got = {}
        for r in merge_intervals(flat, ["k"], gap=0.5, bucket_sec=bucket).collect():
            got.setdefault(r["k"], []).append((r["start"], r["end"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: model([x for x in r if x[1] > x[0]]) for i, r in enumerate(rows) if any(x[1] > x[0] for x in r)}


def test_char_time(column):
    words = [(0, 2, 0.0, 1.0, "ab"), (4, 6, 2.0, 3.0, "cd")]
    places = lambda: F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(w, ("start_char", "end_char", "start_sec", "end_sec", "text"), strict=True))) for w in words))
    assert column(lambda c: T.char_time(c, places()), [1, 3, 7, 0, 6, 2, 4], "int") == [0.5, 1.5, None, 0.0, 3.0, 1.0, 2.0]


def test_word_places(spark):
    words = [(" say", 0.0, 1.0, None), ("“hi,”", 1.0, 2.0, None), ("gone", 2.0, 3.0, None), ("say", 3.0, 4.0, None), ("x", 5.0, 5.0, None), (None, 6.0, 7.0, None)]
    frame = spark.createDataFrame([("say hi say", words), (None, words), ("abc", None)], f"t string, w array<{WORD}>").coalesce(1)
    got = [[(p["start_char"], p["end_char"], p["text"], p["start_sec"]) for p in r[0]] for r in frame.select(T.word_places(F.col("t"), F.col("w"))).collect()]
    assert got == [[(6, 10, " say", 0.0), (4, 6, "hi", 1.0), (7, 10, "say", 3.0)], [], []]


def test_short_chinese_names_start_with_their_word(spark):
    words = [("我叫张伟。", 1.0, 2.0, None)]
    frame = spark.createDataFrame([("我叫张伟。", words, (2, 4, "NAME", "张伟"), 0.0, 5.0)], f"t string, w array<{WORD}>, s struct<start: int, end: int, type: string, text: string>, a double, b double")
    r = frame.select(T.span_interval(F.col("s"), F.col("t"), F.col("a"), F.col("b"), T.word_places(F.col("t"), F.col("w")), tail=0.1, least=0.0)).first()[0]
    assert (round(r["start"], 6), round(r["end"], 6), r["mode"]) == (0.92, 1.9, "word")


@pytest.mark.parametrize(("span", "low", "high", "expected"), [((0, 2), 0.0, 10.0, (0.0, 5.12)), ((3, 99), 0.0, 10.0, (7.5, 10.0)), ((None, 2), 0.0, 10.0, None), ((0, 1), 5.0, 5.0, None), ((0, 1), None, 5.0, None)])
def test_ratio_alignment(spark, span, low, high, expected):
    frame = spark.createDataFrame([("abcd", (*span, "ID", "x"), low, high)], "t string, s struct<start: int, end: int, type: string, text: string>, a double, b double")
    r = frame.select(T.span_interval(F.col("s"), F.col("t"), F.col("a"), F.col("b"), F.expr(f"cast(array() as {T.WORD_PLACES})"))).first()[0]
    assert (None if r is None else (round(r["start"], 6), round(r["end"], 6))) == expected


def test_overlapping_texts(column):
    rows = [["a b c d e f", "c d e f g"], ["a b c", "b c d"], ["我们今天去公园", "今天去公园玩吧"], ["", "x"], [], ["a", None, " b "]]
    assert column(T.merge_chunk_texts, rows, "array<string>") == ["a b c d e f g", "a b c b c d", "我们今天去公园 玩吧", "x", "", "a b"]


def test_stamped_segments_and_srt(column):
    tokens = [["<|en|>", "<|0.5|>", "a", "b", "<|1|>", "<|2.5|>", "c"], ["x"], []]
    got = column(lambda c: T.stamped_segments(c, F.lit(10.0), F.lit(20.0)), tokens, "array<string>")
    assert [[tuple(s) for s in r] for r in got] == [[(10.5, 11.0, "ab"), (12.5, 20.0, "c")], [], []]
    text = column(T.srt, [[(0.0, 1.5, "hi"), (3661.0015, 3662.0, "yo")]], "array<struct<start_sec: double, end_sec: double, text: string>>")[0]
    assert text == "1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n01:01:01,002 --> 01:01:02,000\nyo\n"


def test_mask_options():
    assert MaskOptions.of({"beep_gain_db": 0, "beep_freq_hz": 0, "lead_sec": 0, "mode": "LOUD"}) == MaskOptions()
    assert MaskOptions.of({"pad_sec": 0.3}).tail == 0.3 and MaskOptions.of({"pad_sec": 0.3, "lead_sec": 0}).lead == 0.0


def test_masked_samples():
    import wave

    import numpy as np

    params = wave._wave_params(2, 2, 1000, 1000, "NONE", "")
    plain = np.full((1000, 2), 700, "<i2")
    silent, about = read_wave(mask_wave(write_wave(plain, params), [(0.1, 0.2), (0.95, 9.0)]))
    assert about.nchannels == 2 and len(silent) == 1000 and not silent[100:200].any() and not silent[950:].any() and (silent[200:950] == 700).all()
    loud, _ = read_wave(mask_wave(write_wave(plain, params), [(0.1, 0.2)], MaskOptions(mode="beep", beep_hz=100)))
    assert 6000 < loud[100:200].max() <= 6554 and (loud[:100] == 700).all()


def test_masked_names():
    assert masked_name("/r/a/b.wav", "/r") == ("a/b.masked.wav", "a/b.wav")
    assert masked_name("/x/b.c.wav", "/r") == ("b.c.masked.wav", "b.c.wav")


def test_intervals_carry_over_buckets(spark):
    import random

    from veilscribe.operators.masking import merge_intervals

    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), s := draw.random() * 300, s + draw.choice([0.1, 1, 5, 90, -1])) for _ in range(400)]
    got = merge_intervals(spark.createDataFrame(rows, "k string, start double, end double").repartition(3), ["k"], gap=0.5, bucket_sec=7.0)
    expected = []
    for key in ("a", "b", None):
        merged = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key and e > s):
            if merged and s <= merged[-1][1] + 0.5:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expected += [(key, *m) for m in merged]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert sorted(map(repr, map(tuple, merge_intervals(spark.createDataFrame(rows, "k string, start double, end double"), ["k"], gap=0.5, bucket_sec=None).collect()))) == sorted(map(repr, expected))
