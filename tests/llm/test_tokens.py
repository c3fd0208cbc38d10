import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from veilscribe.llm import packing, queries, token_counts, token_files, vocab

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def texts_of(data):
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


ODD = ["", " ", "\n\n", "a  b", "don't can'T 's", "é́", "x\x00y", "<|endoftext|>", " <|endoftext|><|endoftext|>x", "१२३४ ٣", "ǅ ʰ ͅ", "🙂👍🏽", "​ 　", "ɏɐ͸", "\U0001e6c3 \U00016ea1", "a" * 300, "\r\n\t x", "１２ｘ", "﻿", " a\u0085b\x1c"]


@pytest.mark.parametrize("text", ODD)
def test_encoder_is_the_library(text):
    encoder = vocab.encoder()
    assert encoder.ids(text).tolist() == ids_of(text) and encoder.count(text)[0] == len(ids_of(text))


def test_encoder_is_the_library_on_random_texts():
    draw, encoder = np.random.default_rng(1), vocab.Encoder(memo_entries=64)
    ranges = [(32, 127), (0, 592), (0x370, 0x2000), (0x2000, 0x3100), (0x4E00, 0x4F00), (0xA000, 0xD7FF), (0x10000, 0x1FFFF), (0x20000, 0x33500)]
    for k in range(600):
        low, high = ranges[k % len(ranges)]
        points = draw.integers(low, high, 30)
        text = "".join(chr(c) if draw.random() < 0.7 else " '9,"[c % 4] for c in points.tolist())
        assert encoder.ids(text).tolist() == ids_of(text), [hex(ord(c)) for c in text]


def test_merges_by_ranks_are_the_library_s():
    draw, encoder = np.random.default_rng(2), vocab.Encoder(memo_entries=64)
    # no merge of a provable vocabulary goes through the library, whose tokens are objects
    encoder._model = None
    for k in range(3000):
        letters = ("aehinorst", "aaab", "éüñaeßst", "!?*'.-", "0123456789", "你好ёжαβ", "\n\t ")[k % 7]
        piece = "".join(letters[c] for c in draw.integers(0, len(letters), int(draw.integers(1, 90))).tolist())
        expected = [i for p in encoder.pieces(piece) for i in ids_of(p)]
        assert encoder.ids(piece).tolist() == ids_of(piece) == expected, piece


@pytest.mark.parametrize("merges, ids", [
    ([("a", "b"), ("b", "c"), ("a", "bc")], [256, 257, 258]),  # abc is ab and c, though it is in the vocabulary
    ([("a", "b"), ("b", "c"), ("ab", "c")], [257, 256, 258]),  # ids that do not rise with the list
    ([("a", "b"), ("b", "c"), ("ab", "c")], [256, 257, 258]),
])
def test_merges_that_are_not_by_ranks_stay_the_library_s(tmp_path, merges, ids):
    known = {c: b for c, b in vocab.byte_alphabet().items()} | {"".join(m): i for m, i in zip(merges, ids, strict=True)}
    library = Tokenizer(BPE(known, merges))
    library.pre_tokenizer = ByteLevel(add_prefix_space=False)
    library.save(str(tmp_path / "small.json"))
    encoder = vocab.Encoder(str(tmp_path / "small.json"))
    assert (encoder._ranked is not None) == (merges[2] == ("ab", "c") and ids == sorted(ids))
    for text in ("abc", "abcbc abbc", "bcabc", "aabcc", "cab bca"):
        assert encoder.ids(text).tolist() == library.encode(text).ids


def test_op8_counts(spark, data):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op8_token_counts(spark, data).collect()}
    assert got == {i: (len((t or "").encode()), n := len(ids_of(t)), n > 512) for i, t in texts_of(data)}


def test_op8_odd_rows(odd_docs, no_docs):
    rows = token_counts.count_tokens(odd_docs).collect()
    expected = sorted(str((r["doc_id"], len(ids_of(r["text"])))) for r in odd_docs.collect())
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in rows) == expected and all(r["n_direct"] <= r["n_tokens"] for r in rows)
    assert token_counts.count_tokens(no_docs).collect() == []
    assert token_counts.count_tokens(odd_docs.withColumnRenamed("doc_id", "n_tokens"), "n_tokens").columns == ["n_tokens", "n_bytes", "n_tokens_", "over_limit", "n_direct"]


def test_op6_round_trip(spark, data):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_files(spark, data).collect()}
    expected, at = {}, 0
    for i, t in sorted(texts_of(data)):
        ids = [*ids_of(t), 0]
        expected[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == expected


def test_op6_odd_rows(odd_docs, no_docs):
    files = token_files.write_token_files(odd_docs, shard_ids=5000)
    rows = odd_docs.collect()
    assert sorted(len(x) for x in files.get(5)) == sorted(len(ids_of(r["text"])) + 1 for r in rows if r["doc_id"] == 5)
    assert [x.tolist() for x in files.get(7)] == [[*ids_of(next(r["text"] for r in rows if r["doc_id"] == 7)), 0]]
    assert len(files.get(None)) == 2 and files.get(99) == [] and files.get("7")[0].size > 5000 and len(files.shards) >= 2
    back = files.read(odd_docs, "doc_id").collect()
    assert sorted(str((r["doc_id"], r["ids_crc32"])) for r in back) == sorted(str((r["doc_id"], crc([*ids_of(r["text"]), 0]))) for r in rows)
    ordered = sorted(back, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in ordered])[:-1]]).tolist()
    ids = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert ids == sorted(ids)
    empty = token_files.write_token_files(no_docs)
    assert empty.shards == [] and empty.get(1) == [] and empty.read(no_docs, "doc_id").collect() == []


def test_perfect_hash_is_minimal():
    hashes = np.unique(np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64))
    perfect = token_files.PerfectHash.build(hashes)
    assert np.array_equal(np.sort(perfect(hashes)), np.arange(len(hashes)))
    more = hashes[::-1].copy()
    index = token_files.IndexFile.build(hashes, more, *(np.arange(len(hashes)) for _ in range(3)))
    again = token_files.IndexFile.from_bytes(index.to_bytes())
    inside, held = again.look_up(np.array([hashes[7], hashes[7], 12345], np.uint64), np.array([more[7], 5, 6], np.uint64))
    assert inside.tolist() == [True, False, False] and held["ordinal"].tolist() == [7]


def test_keys_with_one_64_bit_hash_are_told_apart(monkeypatch):
    draw = np.random.default_rng(4)
    hashes, more = draw.integers(0, 50, 3000).astype(np.uint64), np.arange(3000).astype(np.uint64) % np.uint64(977) + draw.integers(0, 2**62, 3000).astype(np.uint64)
    index = token_files.IndexFile.build(hashes, more, *(np.arange(3000) for _ in range(3)))
    inside, held = token_files.IndexFile.from_bytes(index.to_bytes()).look_up(hashes, more)
    assert inside.all() and held["ordinal"].tolist() == list(range(3000))
    with pytest.raises(ValueError, match="128"):
        token_files.IndexFile.build(hashes[[1, 1]], more[[1, 1]], *(np.arange(2) for _ in range(3)))
    # a first seed that makes keys one: another is taken
    together = token_files._together
    monkeypatch.setattr(token_files, "_together", lambda h, m, seed: together(h, m, seed) if seed > 1 else h)
    index = token_files.IndexFile.build(hashes, more, *(np.arange(3000) for _ in range(3)))
    assert index.seed == 2 and index.look_up(hashes, more)[1]["ordinal"].tolist() == list(range(3000))


def test_null_is_no_string_key(spark):
    docs = spark.createDataFrame([(None, "none"), ("null", "word"), ("\0null", "old mark"), ("", "empty"), ("a", "x y"), ("cd", "z")], "doc_id string, text string")
    files = token_files.write_token_files(docs)
    for r in docs.collect():
        assert [x.tolist() for x in files.get(r["doc_id"])] == [[*ids_of(r["text"]), 0]]
    assert files.read(docs, "doc_id", with_ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert files.read(docs, "doc_id").count() == 6 and files.read(docs.filter("doc_id IN ('a', '')"), "doc_id").count() == 2


def test_places_near_each_other_are_one_read(monkeypatch):
    places = list(token_files._near_places(np.array([0, 0, 0, 1, 1]), np.array([0, 2, 40, 0, 1]), np.array([2, 1, 1, 1, 1])))
    assert places == [(0, 2), (2, 3), (3, 5)]
    monkeypatch.setattr(token_files, "READ_IDS", 10)
    assert list(token_files._reads(np.array([0, 4, 9, 30]), np.array([4, 9, 30, 31]))) == [(0, 3), (3, 4)]


def test_a_failed_task_leaves_no_part_files(spark, tmp_path):
    import os

    bad = spark.createDataFrame([(1, "fine"), (2, "bad")], "doc_id long, text string").coalesce(1)
    broken = bad.withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        token_files.write_token_files(broken, folder=str(tmp_path))
    assert not [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".part")]


def test_broken_shards_are_refused(tmp_path):
    (tmp_path / "x.bin").write_bytes(b"VSIDS01\0" + b"\0" * 60)
    with pytest.raises(ValueError, match="shard"):
        token_files.Shard(str(tmp_path / "x.bin"))


def check_packed(rows, docs, length, segments=64, loss=None):
    """Every id once, sequences gapless and within their limits; gives the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    wanted = {}
    for i, t in docs:
        ids = [*ids_of(t), 0]
        wanted.setdefault((i, len(ids)), []).append(ids)
    assert set(by_doc) == set(wanted)
    for key, texts in wanted.items():
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == key[1] * len(texts)
        if len(texts) == 1:
            at = 0
            for r in pieces:
                assert r["start"] == at and r["length"] > 0 and r["ids_crc32"] == crc(texts[0][at : at + r["length"]])
                at += r["length"]
            assert at == key[1]
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and len(pieces) <= segments and (loss is None or sum(r["loss_tokens"] for r in pieces) <= loss)
        used += at
        padded += 0 if at & (at - 1) == 0 else length - at
    return padded / max(1, used + padded)


def test_op1_packs_everything(spark, data):
    rows = queries.op1_packing(spark, data).collect()
    assert check_packed(rows, texts_of(data), 1024, 6, 976) == 0
    # all three limits are met by some sequence, and each holds on its own
    sequences = {}
    for r in rows:
        tokens, segments, loss = sequences.get(r["sequence_id"], (0, 0, 0))
        sequences[r["sequence_id"]] = tokens + r["length"], segments + 1, loss + r["loss_tokens"]
    assert max(t for t, _, _ in sequences.values()) == 1024 and max(s for _, s, _ in sequences.values()) == 6 and max(x for *_, x in sequences.values()) == 976
    assert len(sequences) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 40


def test_first_lines_bear_no_loss(spark, data):
    sizes = np.array([len(b) for b in vocab.encoder().token_bytes])
    texts = {i: t or "" for i, t in texts_of(data)}
    loss = {}
    for r in queries.op1_packing(spark, data).collect():
        loss[r["doc_id"]] = loss.get(r["doc_id"], 0) + r["loss_tokens"]
    for i, text in texts.items():
        ids, first = ids_of(text), len((text[: text.find("\n") + 1]).encode())
        bare = sum(end <= first for end in np.cumsum(sizes[ids]).tolist()) if ids else 0
        assert loss[i] == len(ids) + 1 - bare


def test_the_greatest_dot_product_is_taken():
    draw = np.random.default_rng(12)
    limits = np.array([100, 5, 60])
    for _ in range(40):
        packer = packing.Packer(*limits.tolist(), pool=1000)
        pieces = [packing.Piece((k, 0), np.zeros(n, np.uint16), 0, int(draw.integers(0, n + 1))) for k, n in enumerate(draw.integers(1, 40, 60).tolist())]
        for p in pieces:
            assert not list(packer.add(p))
        open_ = list(packer.pieces)
        left = limits.astype(float)
        for chosen in packer._sequence():
            if chosen not in open_:
                break  # from here on pieces are cut
            demand = {id(p): np.array([len(p.ids), 1, p.loss]) for p in open_}
            fit = [p for p in open_ if (demand[id(p)] <= left).all() and (left[1] > 1 or len(p.ids) == left[0])]
            score = lambda p: float((demand[id(p)] / limits) @ (left / limits))  # noqa: B023, E731
            assert score(chosen) == pytest.approx(max(map(score, fit)))
            open_.remove(chosen)
            left -= demand[id(chosen)]


def test_op1_odd_rows_and_limits(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for limits in ({"length": 64, "max_segments": 3, "max_loss": 40}, {"length": 1024, "max_segments": 64, "max_loss": 1024}, {"length": 7, "max_segments": 1, "max_loss": 7}):
        rows = packing.pack(odd_docs, pool=8, **limits).collect()
        check_packed(rows, docs, limits["length"], limits["max_segments"], limits["max_loss"])
    assert packing.pack(no_docs).collect() == []


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "tell me a story", "once upon a time " * 40), (2, None, "x"), (3, "only a prompt " * 50, None)], "doc_id long, prompt string, text string").coalesce(1)
    rows = packing.pack(docs, prompt_col="prompt", length=32, max_segments=4, max_loss=20).collect()
    loss = {}
    for r in rows:
        loss[r["doc_id"]] = loss.get(r["doc_id"], 0) + r["loss_tokens"]
    assert loss == {1: len(ids_of("once upon a time " * 40)) + 1, 2: 2, 3: 1}
    assert all(sum(r["loss_tokens"] for r in rows if r["sequence_id"] == s) <= 20 for s in {r["sequence_id"] for r in rows})
    with pytest.raises(Exception, match="limits"):
        packing.pack(docs.withColumn("prompt", F.lit(None)), length=0).collect()
