import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilscribe.llm import fertility, mixing, queries, substrings, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = (
    "The harbour was quiet when we arrived, and only a few gulls circled above the moored boats. An old man sat mending his nets; he nodded at us without a word. "
    "Further along the quay somebody had left a radio playing, so that a thin tune drifted over the water. We bought bread, cheese and two oranges from the shop on the corner, "
    "then walked up the hill to watch the evening ferry come in from the islands."
)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_op9_base_is_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op9_fertility(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == base(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (r["reason"] is None) and not (r["kept"] and r["base_failed"])


def test_op9_odd_rows(odd_docs, no_docs):
    rows = fertility.assess(odd_docs, carry=("n_words", "copy")).collect()
    assert len(rows) == odd_docs.count() and rows[0].__fields__[:5] == ["doc_id", "n_words", "copy", "n_words_", "word_chars"]
    assert fertility.assess(no_docs).collect() == []
    assert fertility.assess(odd_docs, lang_col=None).count() == len(rows)


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("The committee met on Tuesday to discuss the new budget and agreed that further work was needed before a decision could be made. " * 3, False),
        (PROSE, True),
        (" ".join("".join(random.Random(f"{i} {k}").choice("zqxjkvwbp0123456789") for k in range(12)) for i in range(80)), False),
        (" ".join(f"{'ab' * 300}{i}" for i in range(60)), False),
        ("", False), (None, False),
    ],
)
def test_verdicts(spark, text, kept):
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert fertility.assess(docs).first()["kept"] is kept


def test_op9_measures_are_brute_force(spark, data):
    """Tokens of the libraries themselves, and every measure and verdict from them."""
    import base64
    import math

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    english = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelling = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    spelling |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in spelling.values())}

    def whole(raw):
        try:
            raw.decode()
        except UnicodeDecodeError:
            return False
        return True

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    seen = set()
    for r in queries.op9_fertility(spark, data).collect():
        text, lang = docs[r["doc_id"]]["text"] or "", docs[r["doc_id"]]["lang"]
        name = lang if lang in fertility.BANDS else fertility.script_of(text)
        band = fertility.BANDS[name]
        if band.vocabulary == "english":
            ids = english.encode(text, add_special_tokens=False).ids
            fragment = lambda i: not whole(bytes(spelling[c] for c in english.id_to_token(i)))
        else:
            ids = multi.encode_ordinary(text)
            fragment = lambda i: not whole(multi.decode_single_token_bytes(i))
        n = len(ids)
        assert (r["n_tokens"], r["band"]) == (n, name)
        reason = None
        if r["n_words"] < 50:
            reason = "words"
        elif 100 * r["n_repeat_words"] > 50 * r["n_words"]:
            reason = "repetition"
        if n:
            chars, share = len(text) / n, sum(map(fragment, ids)) / n
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
            assert (r["chars_per_token"], r["byte_fallback"], r["entropy"]) == pytest.approx((chars, share, entropy), abs=1e-9)
            if not reason and not band.least_chars <= chars <= band.most_chars:
                reason = "chars_per_token"
            if not reason and share > band.most_fragments:
                reason = "byte_fallback"
            if not reason and n > 1 and entropy < min(band.least_entropy * math.log2(n), fertility.ENOUGH_ENTROPY):
                reason = "entropy"
        assert (r["reason"], r["kept"]) == (reason, reason is None)
        seen.add(reason)
    assert {None, "words", "repetition"} <= seen and len(seen) > 3


def test_scripts_have_their_bands(spark):
    cases = {"han": "我们今天去公园玩了很久然后回家吃饭睡觉", "kana": "わたしは今日こうえんに行きました", "cyrillic": "Сегодня мы ходили гулять в парк", "arabic": "ذهبنا اليوم إلى الحديقة", "latin": "naïve façade", "other": "123 !?", "hangul": "오늘 우리는 공원에 갔다", "greek": "σήμερα πήγαμε", "thai": "วันนี้เราไป", "hebrew": "היום הלכנו", "indic": "आज हम पार्क गए"}
    assert {k: fertility.script_of(v) for k, v in cases.items()} == {k: k for k in cases}


def test_clean_documents_are_kept(spark, data):
    good = spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    judged = queries.op9_fertility(spark, data).join(good, "doc_id").filter("NOT base_failed")
    n, kept = judged.count(), judged.filter("kept").count()
    assert n > 20 and kept >= 0.97 * n


# -------------------------------------------------------------------- substrings


def removed(rows, window):
    """By document: words gone, and the rest.  Rows are in the order of the corpus."""
    seen, out = set(), []
    for i, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            if run in seen:
                gone.update(range(k, k + window))
            seen.add(run)
        out.append((i, len(words), len(gone), [w for k, w in enumerate(words) if k not in gone]))
    return out


def test_op10_is_brute_force(spark, data):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    expected = {i: (n, g, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, g, kept in removed(rows, 20)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op10_substrings(spark, data).collect()} == expected
    assert any(g for _, g, _ in expected.values())


def abc(window):
    draw = random.Random(window)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(0, 14)))) for i in range(60)] + [(60, None), (61, "  "), (62, "é ü ñ é ü ñ é ü ñ")]
    return rows + [(63 + k, f"{draw.choice('abc')} x y z x y z a b c d e f g {draw.choice('abc')}") for k in range(12)]


SMALL = [(2, 60, 5, 2), (3, 1, 1, 1), (4, 10_000, 10_000, 1024), (7, 100, 1, 1), (6, 10_000, 3, 4)]


@pytest.mark.parametrize(("window", "block", "task", "classes"), SMALL)
def test_small_windows_and_blocks(spark, window, block, task, classes):
    rows = abc(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(docs, window=window, block_bytes=block, task_suffixes=task, first_classes=classes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], WORD.findall(r["text"] or "")) for r in got} == {i: (n, g, kept) for i, n, g, kept in removed(rows, window)}


def passages(rows, window):
    """Maximal runs of windows that repeat, one after another, places where the windows are for the first time."""
    seen, out = {}, []
    for i, text in rows:
        words, run = WORD.findall(text or ""), None
        for k in range(len(words) - window + 1):
            of, at = seen.setdefault(tuple(words[k : k + window]), (i, k))
            if (of, at) == (i, k):
                run = None
            elif run and (of, at) == (run[3], run[4] + run[2] - window + 1):
                run[2] += 1
            else:
                run = [i, k, window, of, at]
                out.append(run)
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("window", "block", "task", "classes"), SMALL)
def test_maximal_repeats_are_brute_force(spark, window, block, task, classes):
    docs = spark.createDataFrame(abc(window), "doc_id long, text string").repartition(5)
    got = substrings.maximal_repeats(docs, window=window, block_bytes=block, task_suffixes=task, first_classes=classes)
    assert got.columns == ["doc_id", "start", "length", "first_id", "first_start"]
    assert sorted(map(tuple, got.collect())) == passages(abc(window), window)


def test_maximal_repeats_of_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected = passages(rows, 20)
    assert sorted(map(tuple, substrings.maximal_repeats(docs, block_bytes=50_000, task_suffixes=500).collect())) == expected and max(r[2] for r in expected) > 50
    assert substrings.maximal_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hashes", [1, 2, 7])
def test_words_are_compared_and_not_their_hashes(hashes):
    """With a hash that hardly tells words apart, in blocks and in trees."""
    rows, window = abc(4), 4
    told = substrings.word_hash
    substrings.word_hash = lambda word: len(word) * 31 % hashes
    try:
        import numpy as np

        block = substrings.Block.of([t for _, t in rows], np.arange(len(rows)), window)
        at, bits, later, _ = block.heads(np.arange(len(block.anchors)))
        contexts = block.contexts(at, bits)
        suffix, k, _ = substrings.repeats(contexts, bits, window)
    finally:
        substrings.word_hash = told
    starts = sorted([*later.tolist(), *(at[suffix] - k).tolist()])
    seen, expected, base_ = set(), [], 0
    for _, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            expected += [base_ + i] * (run in seen)
            seen.add(run)
        base_ += len(words)
    assert starts == expected


def test_trees_are_their_words():
    import numpy as np

    draw = np.random.default_rng(2)
    words = draw.integers(0, 3, (6, 200))
    tree = substrings.Tree(words)
    columns = [tuple(c) for c in words.T]
    assert [columns[k] for k in tree.order] == sorted(columns)
    for depth in range(7):
        classes = {}
        for node, column in zip(tree.nodes(depth).tolist(), columns, strict=True):
            classes.setdefault(node, set()).add(column[:depth])
        assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({c[:depth] for c in columns})


def test_prefixes_are_extended_until_they_fit():
    import numpy as np

    texts = ["the cat sat on the mat and looked at me"] * 3 + [f"the cat sat on the mat and looked {k}" for k in range(200)] + [f"word{k} b c d e f g" for k in range(50)]
    block = substrings.Block.of(texts, np.arange(len(texts)), 7)
    at, bits, _, _ = block.heads(np.arange(len(block.anchors)))
    prefixes, rounds = substrings.Prefixes(7 - substrings.places(7) + 1, 4), 0
    while True:
        node, _, some = prefixes.deal(block, at, bits)
        sizes = dict(enumerate(np.bincount(node).tolist()))
        if not prefixes.extend({k: n for k, n in sizes.items() if n}, 20):
            break
        rounds += 1
    assert 1 < rounds <= prefixes.anchor and max(n for k, n in sizes.items() if prefixes.depth[k] <= prefixes.anchor) <= 20
    assert sum(map(int.bit_count, some.tolist())) == sum(map(int.bit_count, bits.tolist()))


def test_op10_odd_rows(odd_docs, no_docs):
    got = substrings.remove_repeats(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_words_", "n_removed_"]
    rows = {(r["doc_id"], r["n_words"]): r for r in got.collect()}
    before = {(r["doc_id"], r["n_words"]): r for r in odd_docs.collect()}
    assert set(rows) == set(before)
    assert all(r["text"] == before[k]["text"] for k, r in rows.items() if not r["n_removed_"])
    by_id = {k[0]: r["n_removed_"] for k, r in rows.items()}
    assert by_id[7] == 0 and by_id[9] == 18_000
    assert substrings.remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError, match="window"):
        substrings.remove_repeats(no_docs, window=1)


def test_white_space_after_a_removed_word_goes_with_it(spark):
    docs = spark.createDataFrame([(1, "a b c\n\nd"), (2, "x  a b c\n y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs, window=3).collect()} == {1: "a b c\n\nd", 2: "x  y"}


# ------------------------------------------------------------- mixing and URL lists


def test_mix_hits_its_weights(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS source")
    weights = spark.createDataFrame([("big", 1.0), ("mid", 1.0), ("small", 2.0), ("gone", 5.0)], "source string, weight double")
    out = mixing.mix(docs, weights, seed=3)
    share = {r["source"]: r["n"] / out.count() for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(share["big"] - 0.25) < 0.02 and abs(share["small"] - 0.5) < 0.03 and "gone" not in share
    assert out.count() == pytest.approx(6000, rel=0.05)
    again = mixing.mix(docs.repartition(7), weights, seed=3)
    assert again.exceptAll(out).count() == 0 and out.exceptAll(again).count() == 0
    other = mixing.mix(docs, weights, seed=4)
    assert other.exceptAll(out).count() > 0
    places = [[r["place"] for r in p] for p in out.select("place").rdd.glom().collect()]
    flat = [x for p in places for x in p]
    assert flat == sorted(flat)


def test_poisson_with_large_means(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('y', CASE WHEN id < 10 THEN 10 ELSE 1000 END) AS text", "IF(id < 10, 'rare', 'common') AS source")
    weights = spark.createDataFrame([("rare", 1.0), ("common", 9.0)], "source string, weight double")
    n = mixing.mix(docs, weights, seed=1).filter("source = 'rare'").groupBy("doc_id").agg(F.max("copies").alias("c")).agg(F.avg("c"), F.stddev("c"), F.count("*")).first()
    mean = 0.1 * (990 * 1000 + 100) / 100
    assert n[2] == 10 and abs(n[0] - mean) < 4 * (mean / 10) ** 0.5


def test_op3_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs, mixing.tempered(odd_docs), seed=5)
    assert out.columns == [*odd_docs.columns, "copy_", "copies", "place"]
    assert mixing.mix(no_docs, mixing.tempered(no_docs)).collect() == []
    twins = out.filter("doc_id = 5").groupBy("text", "n_words").agg(F.max("copies").alias("c")).collect()
    assert len({r["c"] for r in twins}) <= 2


def test_url_lists_by_date(spark):
    days = lambda *rows: spark.createDataFrame(rows, "pattern string, list string, action string, since string").withColumn("since", F.to_date("since"))
    entries = days(("Bad.com", "spam", "ADD", "2024-01-10"), ("bad.com", "spam", "remove", "2024-02-01"), ("bad.com", "spam", "add", "2024-03-01"), ("x.bad.com", "adult", "add", "2024-01-01"), ("bad.com", "tie", "remove", "2024-01-05"), ("bad.com", "tie", "add", "2024-01-05"), (None, "spam", "add", "2024-01-01"), ("bad.com", "odd", "maybe", "2024-01-01"))
    asked = [("http://bad.com/", "2024-01-09"), ("http://bad.com/", "2024-01-10"), ("http://user@WWW.Bad.com.:80/a?b", "2024-01-31"), ("http://bad.com", "2024-02-01"), ("http://x.bad.com/", "2024-03-01"), ("http://notbad.com/", "2024-01-15"), (None, "2024-01-15"), ("mailto:a", "2024-01-15"), ("http://bad.com/", None)]
    captures = spark.createDataFrame([(i, *a, "mine") for i, a in enumerate(asked)], "i int, url string, fetched_on string, host string").withColumn("fetched_on", F.to_date("fetched_on"))
    got = {r["i"]: (r["host_"], r["lists"], r["blocked"]) for r in url_lists.judge(captures, entries).collect()}
    assert got == {0: ("bad.com", ["tie"], True), 1: ("bad.com", ["spam", "tie"], True), 2: ("www.bad.com", ["spam", "tie"], True), 3: ("bad.com", ["tie"], True), 4: ("x.bad.com", ["adult", "spam", "tie"], True), 5: ("notbad.com", [], False), 6: (None, [], False), 7: (None, [], False), 8: ("bad.com", [], False)}
    assert url_lists.judge(captures, entries.limit(0)).filter("blocked").count() == 0 and url_lists.judge(captures.limit(0), entries).collect() == []


def test_url_lists_of_addresses(spark):
    days = lambda *rows: spark.createDataFrame(rows, "pattern string, list string, action string, since string").withColumn("since", F.to_date("since"))
    entries = days(("[2001:db8::1]", "six", "add", "2024-01-01"), ("10.0.0.1", "four", "add", "2024-01-01"), ("0.1", "wrong", "add", "2024-01-01"), ("1", "wrong", "add", "2024-01-01"), ("0.1.example", "names", "add", "2024-01-01"))
    urls = ["http://[2001:DB8::1]/", "http://u:p@[2001:db8::1]:8080/x", "http://[2001:db8::2]/", "http://10.0.0.1:80/", "http://10.0.0.2/", "http://10.0.0.1.example/", "http://[2001:db8::1", "http://10.0.0.0.1/"]
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").withColumn("fetched_on", F.to_date(F.lit("2024-02-01")))
    got = {r["i"]: (r["host"], r["lists"]) for r in url_lists.judge(captures, entries).collect()}
    assert got == {0: ("[2001:db8::1]", ["six"]), 1: ("[2001:db8::1]", ["six"]), 2: ("[2001:db8::2]", []), 3: ("10.0.0.1", ["four"]), 4: ("10.0.0.2", []), 5: ("10.0.0.1.example", ["names"]), 6: (None, []), 7: ("10.0.0.0.1", ["wrong"])}


def test_url_lists_by_the_second_and_a_long_url(spark):
    draw = random.Random(8)
    changes = [("hot.com" if draw.random() < 0.5 else f"h{draw.randrange(4)}.com", draw.choice("ab"), draw.choice(["add", "remove"]), draw.randrange(100)) for _ in range(150)]
    asked = [(i, f"http://{draw.choice(['x.hot.com', 'hot.com', 'h1.com', 'other.org'])}/{'long' * (5000 if i == 3 else 1)}", draw.randrange(100)) for i in range(300)]
    entries = spark.createDataFrame(changes, "pattern string, list string, action string, t int").withColumn("since", F.timestamp_seconds("t"))
    captures = spark.createDataFrame(asked, "i int, url string, t int").withColumn("fetched_on", F.timestamp_seconds("t"))
    got = {r["i"]: r["lists"] for r in url_lists.judge(captures, entries).collect()}
    for i, url, t in asked:
        host = url.split("/")[2]
        held = set()
        for name in "ab":
            for pattern in {p for p, *_ in changes if host == p or host.endswith("." + p)}:
                last = max(((s, a == "add") for p, n, a, s in changes if (p, n) == (pattern, name) and s <= t), default=(0, False))
                held |= {name} if last[1] else set()
        assert got[i] == sorted(held), (i, url, t)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_have_their_sql(spark, data, name):
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    found = queries.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    expected = con.sql(queries.SQL[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(str, expected))
