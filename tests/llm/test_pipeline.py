import itertools
import random

import corpus_pipeline
from brute import roots
from test_documents import base, removed
from test_tokens import check_packed

from veilscribe.llm import fertility, simhash


def staged(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, "")
    return docs


def test_stages_hand_on(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, data)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == names and all(not base(rows[i]["text"])[5] for i in kept)
    assert {r["doc_id"] for r in fertility.assess(docs).filter("kept").collect()} == kept

    single = corpus_pipeline.near_dedup(spark, good, data)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == names and set(left) <= kept
    texts = {}
    for i in sorted(kept):
        texts.setdefault(rows[i]["text"], i)
    assert set(left) <= set(texts.values()), "of equal texts only the first stays"

    cleaned = corpus_pipeline.substring_dedup(spark, single, data)
    assert cleaned.columns == names
    expected = {i: words for i, _, _, words in removed(sorted(left.items()), 20)}
    assert {r["doc_id"]: r["text"].split() for r in cleaned.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())

    mixed = corpus_pipeline.mixing_sources(spark, cleaned, data)
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} <= set(left)
    packed = corpus_pipeline.pack(spark, mixed, data).collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()], 1024, 6, 976)


def test_run_is_its_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    again = staged(spark, spark.read.parquet(f"{data}/documents.parquet"), 4)
    expected = {}
    for r in again.collect():
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + 1
    got = {}
    for r in out.filter("start = 0").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == expected


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        packed = corpus_pipeline.pack(spark, docs, "").collect()
        check_packed(packed, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024, 6, 976)
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd_docs, "").collect()]
    assert ids.count(5) == 1 and ids.count(None) == 2 and 9 not in ids and 12 not in ids
    assert staged(spark, no_docs, 5).collect() == []


def test_near_dedup_is_all_pairs(spark):
    """Pairs at Jaccard similarities from about 0.78 to 0.95 over five-word shingles."""
    draw, rows = random.Random(3), []
    for k in range(450):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in range(draw.randrange(1, 8)):
            other[10 + 40 * at] = f"x{draw.randrange(5000)}"
        rows += [(k, " ".join(words)), (1000 + k, " ".join(other))]
    prints = [int.from_bytes(simhash.fingerprint(t, 5, 4), "big") for _, t in rows]
    pairs = [(rows[i][0], rows[j][0]) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 52]
    expected = set(roots(pairs, [i for i, _ in rows]).values())
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(pairs) > 400 and expected <= kept, "nothing unlike goes"
    assert len(kept - expected) <= 0.01 * len(pairs), "near copies go"
