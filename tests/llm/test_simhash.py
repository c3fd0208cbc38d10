import dataclasses
import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from brute import roots

from veilscribe.llm import graph, queries, simhash
from veilscribe.llm.store import Workspace


def plain_fingerprint(text, n=3):
    import re

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def expected(rows, most=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= most]
    root = roots(edges, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    return sorted(str((i, f"{prints[k]:016x}", least[root[k]])) for k, (i, _) in enumerate(rows))


def test_op2_is_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op2_simhash(spark, data).collect()) == expected(docs)


def test_op2_odd_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert sorted(str((r["doc_id"], bytes(r["fingerprint"]).hex(), r["component_id"])) for r in found) == expected([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("text", ["A b C d", "a b", "", None, "É ÀB", "x " * 400, "  a\x0b\x1cb c\n"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "").hex() == f"{plain_fingerprint(text):016x}"


def test_bit_counts():
    hashes = np.random.default_rng(0).integers(0, 2**63, 70_001).astype(np.uint64)
    assert simhash._bit_counts(hashes).tolist() == [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize(("chunk", "n"), [(4, 0), (512, 0), (4, 10**11), (512, 10**12)])
def test_every_near_pair_is_linked(spark, chunk, n):
    draw = random.Random(chunk)
    values = {draw.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            x = v
            for b in draw.sample(range(64), draw.randrange(1, 5)):
                x ^= 1 << b
            values.add(x)
    values |= {0, 1, 3, 7, 15, 31, 1 << 63}
    values = sorted(values)
    frame = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fingerprint binary")
    space = Workspace(spark, "test")
    edges = simhash.links(frame, simhash.Cover.exact(3, n), space, chunk=chunk)
    found = roots([(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in edges.collect()], values)
    assert found == roots([(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3], values)


def test_manhattan_bounds_hamming():
    draw = np.random.default_rng(4)
    a, b = (draw.integers(0, 2**63, (5000, 1)).astype(np.uint64) for _ in range(2))
    cover = simhash.Cover.exact(3)
    counts = np.bitwise_count(cover.counts(a) ^ cover.counts(b))
    assert (counts <= np.bitwise_count(a ^ b)).all()


def met(cover, a, b):
    """Which rows of a and b share a cell that is the own one of either."""
    out = np.zeros(len(a), bool)

    def table(prints):
        cells = {}
        for rows, cell, own in cover.cells(prints):
            for r, c in zip(rows.tolist(), cell.tolist(), strict=True):
                cells.setdefault(r, {})[c] = cells.get(r, {}).get(c, False) or own
        return cells

    left, right = table(a), table(b)
    for k in range(len(a)):
        out[k] = any(own or right[k][c] for c, own in left[k].items() if c in right[k])
    return out


@pytest.mark.parametrize(("most", "n"), [(0, 0), (1, 0), (2, 0), (3, 0), (3, 10**10), (3, 10**12), (5, 0), (5, 10**11)])
def test_exact_covers_miss_no_pair(most, n):
    draw, cover = np.random.default_rng(most), simhash.Cover.exact(most, n)
    a = draw.integers(0, 2**64, (300, 1), np.uint64, endpoint=False)
    far = np.argsort(draw.random((len(a), 64)), axis=1) < most
    assert met(cover, a, a ^ np.packbits(far, axis=1, bitorder="little").view(np.uint64)).all()
    assert cover.reach == (most > 0 and n < 10**10)
    held = {c for _, cell, own in cover.cells(a[:1]) if own for c in cell.tolist()}
    assert len(held) == len(cover.picks)
    unlike = met(cover, a, draw.integers(0, 2**64, (300, 1), np.uint64, endpoint=False))
    assert most == 5 or unlike.sum() <= 1, "cells are small"


def test_with_least_is_a_minimum_by_key(spark):
    draw = random.Random(4)
    rows = [(draw.choice([1, 1, 1, 2, 3]), draw.choice([None, *range(50)]), k) for k in range(400)] + [(9, None, 400)]
    found = graph.with_least(spark.createDataFrame(rows, "k int, v int, i int"), "k", "v", "m").collect()
    least = {k: min((v for j, v, _ in rows if j == k and v is not None), default=None) for k in {1, 2, 3, 9}}
    assert sorted(map(str, map(tuple, found))) == sorted(str((k, v, i, least[k])) for k, v, i in rows)


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(frame, Workspace(spark, "test")).collect()}
    assert got == {n: r for n, r in roots(edges, {x for e in edges for x in e}).items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(frame.limit(0), Workspace(spark, "test")).collect() == []


def test_wide_cover_finds_near_copies(spark):
    draw = random.Random(7)
    base = [" ".join(draw.choice("abcdefghijklmnop") * draw.randrange(1, 4) + str(draw.randrange(500)) for _ in range(200)) for _ in range(30)]
    rows = []
    for k, text in enumerate(base):
        words = text.split()
        words[draw.randrange(200)] = "changed"
        rows += [(k, text), (100 + k, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from corpus_pipeline import NEAR

    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle_words=5, cover=NEAR).collect()}
    assert got == {i: i % 100 for i, _ in rows}


@pytest.mark.parametrize(("bits", "reach"), [(1, 0), (1, 1), (2, 0), (2, 1)])
def test_sampled_covers_meet_at_the_full_radius(bits, reach):
    draw = np.random.default_rng(11)
    a = draw.integers(0, 2**64, (1500, 4), np.uint64, endpoint=False)
    far = np.argsort(draw.random((len(a), 256)), axis=1) < 52
    b = a ^ np.packbits(far, axis=1, bitorder="little").view(np.uint64)
    assert (np.bitwise_count(a ^ b).sum(axis=1) == 52).all()
    cover = simhash.Sampling(52, 4, 0.99, bits=bits, reach=reach).cover(20_000)
    assert met(cover, a, b).mean() > 0.98
    once = simhash.Cover.sampled(52, 4, 1, len(cover.picks[0]), bits=bits, reach=reach)
    assert met(once, a, b).mean() == pytest.approx(once.meeting(), abs=0.04)


@pytest.mark.parametrize("n", [1, 11, 12, 13, 64, 65, 700])
def test_forest_is_all_pairs(n):
    draw = np.random.default_rng(n)
    prints = draw.integers(0, 2**64, (n, 4), np.uint64, endpoint=False)
    for k in range(1, n, 2):
        flips = draw.choice(256, draw.integers(40, 60), replace=False)
        prints[k] = prints[k // 3] ^ np.packbits(np.isin(np.arange(256), flips), bitorder="little").view(np.uint64)
    own = draw.random(n) < 0.7
    a, b = simhash._forest(simhash.Cover.sampled(52, 4, 1, 1), prints, own)
    pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if (own[i] or own[j]) and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 52]
    assert roots(zip(a.tolist(), b.tolist(), strict=True), range(n)) == roots(pairs, range(n))
    assert (b < a).all()


@pytest.mark.parametrize("n", [0, 1, 500, 44_000, 222_000, 13_000_000, 10**9])
def test_recall_within_the_radius_holds_at_any_size(n):
    from corpus_pipeline import NEAR

    cover = NEAR.cover(n)
    chances = [dataclasses.replace(cover, most=apart).meeting() for apart in range(NEAR.most + 1)]
    assert chances == sorted(chances, reverse=True)
    assert all(1 - (1 - p) ** len(cover.picks) >= 0.99 for p in chances)
