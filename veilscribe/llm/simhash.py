"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments, and each segment is mapped to its number of set
bits.  The Manhattan distance of two such count vectors is at most the Hamming distance
of the fingerprints.  A grid over some of the counts is joined by range: a fingerprint
lies in the cell of its counts, and is held against those of its own cell and of the
cells where one count is greater or less by one.  Pairs whose Manhattan distance over
all counts is small enough are verified exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.graph import components, with_least
from veilscribe.llm.store import Workspace, free, tidy

_U = np.uint64
_LANES, _ODD = _U(0x0101010101010101), _U(0x5555555555555555)
#: A cell of more fingerprints is dealt out in chunks of about this size, or 8 times the root of the cell's.
CHUNK = 512
_SMALL = 12


# ------------------------------------------------------------------------ fingerprints


def shingles(text: str, n: int) -> list[bytes]:
    """Runs of n words, A-Z in lower case, joined by one space; the whole text if it has fewer."""
    words = text.encode().lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends - 1).tolist()[n - 1 :], strict=False)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, from bit 0 on.  Sums eight bits of 255 hashes at a time in the bytes of a word."""
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        rows = np.zeros((-(-len(part) // 255), 255), _U)
        rows.reshape(-1)[: len(part)] = part
        for k in range(8):
            lanes = ((rows >> _U(k)) & _LANES).sum(axis=1, dtype=_U)
            counts[:, k] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(-1)


def fingerprint(text: str, shingle_words: int = 3, words: int = 1) -> bytes:
    """The SimHash of a text, 64 bits for each of ``words``, big-endian; zero for a text without words.

    Word k of it takes XXH64 with seed 42 + k; a bit is set if it is in over half the hashes.
    """
    runs, out = shingles(text, shingle_words), b""
    for seed in range(42, 42 + words):
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, seed) for r in runs), _U, len(runs))
        bits = 2 * _bit_counts(hashes) > len(runs)
        out += np.packbits(bits, bitorder="little").tobytes()[::-1]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 3, words: int = 1) -> DataFrame:
    """id, fingerprint (binary) of every whole text; a null text has no words.  No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprint(text or "", shingle_words, words) for (text,) in vocab.rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "fingerprint"])

    return source.mapInArrow(tidy(run), f"id {kind}, fingerprint binary")


# ------------------------------------------------------------------------------- cover


@dataclass(frozen=True)
class Cover:
    """Which grid cells a fingerprint lies in, and how near two must be.

    ``bits`` is the length of a segment, 1 or 2.  Each of ``picks`` is a grid over the
    counts of some segments.  Two fingerprints meet in it if these counts are the same
    or, with ``reach`` 1, if one of them differs by one.
    """

    words: int
    most: int
    bits: int
    picks: tuple[tuple[int, ...], ...]
    reach: int = 0

    @classmethod
    def exact(cls, most: int, n: int = 0, words: int = 1) -> Cover:
        """Every pair within ``most`` bits meets.

        Of ``most // 2 + 1`` parts of the fingerprint two differ in at most one bit of one, so
        that a range join of the counts of each part finds them.  Where ``n`` fingerprints
        would crowd such a grid, of more parts two agree on all but ``most``.
        """
        segments, parts = 32 * words, most // 2 + 1
        if _crowd(n, segments // parts) <= CROWD or not most:
            return cls(words, most, 2, tuple(map(tuple, np.array_split(np.arange(segments), parts))), min(most, 1))
        parts = 2 * most
        while _crowd(n, segments * (parts - most) // parts) > CROWD and parts < min(segments, 4 * most):
            parts += 1
        groups = np.array_split(np.arange(segments), parts)
        return cls(words, most, 2, tuple(tuple(np.concatenate(chosen).tolist()) for chosen in combinations(groups, parts - most)))

    @classmethod
    def sampled(cls, most: int, words: int, tables: int, segments: int, seed: int = 1, bits: int = 1, reach: int = 0) -> Cover:
        """``tables`` grids over random picks of ``segments``."""
        draw = np.random.default_rng(seed)
        return cls(words, most, bits, tuple(tuple(draw.choice(64 * words // bits, segments, replace=False).tolist()) for _ in range(tables)), reach)

    def counts(self, prints: np.ndarray) -> np.ndarray:
        """Segment counts in unary: the bits that two of these differ in are the Manhattan distance of the counts."""
        if self.bits == 1:
            return prints
        high = prints >> _U(1)
        return ((prints | high) & _ODD) | (((prints & high) & _ODD) << _U(1))

    def segment_counts(self, prints: np.ndarray) -> np.ndarray:
        """The count of each segment, a row for each segment."""
        bits = np.unpackbits(np.ascontiguousarray(prints.astype("<u8")).view(np.uint8), axis=1, bitorder="little").T
        return bits if self.bits == 1 else bits[::2] + bits[1::2]

    def cells(self, prints: np.ndarray):
        """Rows of ``prints`` and a cell of each, and whether it is the row's own; the others are where one count is greater by one."""
        counts, every = self.segment_counts(prints), np.arange(len(prints))
        worth = np.random.default_rng(5).integers(0, 2**64, (len(counts), self.bits + 1), np.uint64, endpoint=False)
        with np.errstate(over="ignore"):
            for k, pick in enumerate(self.picks):
                own = np.full(len(prints), ((k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1), _U)
                for s in pick:
                    own += worth[s][counts[s]]
                yield every, _stirred(own), True
                for s in pick if self.reach else ():
                    less = np.flatnonzero(counts[s] < self.bits)
                    at = counts[s][less]
                    yield less, _stirred(own[less] - worth[s][at] + worth[s][at + 1]), False

    def meeting(self) -> float:
        """How likely two fingerprints that differ in ``most`` random bits are to meet in a grid of random segments."""
        size, k = 64 * self.words // self.bits, len(self.picks[0])
        both = self.most * (self.most - 1) / (128 * self.words - 2) if self.bits == 2 else 0.0
        one = self.most - 2 * both
        return _meeting(size - one - both / 2, one, size, k, self.reach)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


#: Unrelated fingerprints that a cell of an exact cover should hold at most; a segment's count tells this many bits.
CROWD, _TELLS = 512, 1.5


def _crowd(n: int, segments: int) -> float:
    """Fingerprints in a cell of so many segments of two bits, of ``n`` that are spread evenly."""
    return n / 2.0 ** (_TELLS * segments)


def _meeting(equal: float, one: float, size: int, k: int, reach: int) -> float:
    """The chance that k of ``size`` segments are all of the ``equal`` ones, or with ``reach`` 1 but one of the ``one`` that differ by one."""
    agree = math.exp(math.lgamma(equal + 1) - math.lgamma(equal - k + 1) + math.lgamma(size - k + 1) - math.lgamma(size + 1)) if equal >= k else 0.0
    return min(1.0, agree + reach * agree * one * k / (equal - k + 1) if k else agree)


@dataclass(frozen=True)
class Sampling:
    """A sampled cover that grows with the corpus and has the same recall at any size.

    A cell holds about 2 ** ``crowd`` unrelated fingerprints at most, which are held
    against each other.  There are as many tables as two fingerprints that differ in
    ``most`` bits need to meet with probability ``recall``, at any size; nearer ones meet
    more often.  ``bits`` and ``reach`` are those of the cover.
    """

    most: int
    words: int
    recall: float
    crowd: int = 9
    bits: int = 1
    reach: int = 0

    def cover(self, n: int) -> Cover:
        size, k = 64 * self.words // self.bits, 0
        # counts of unrelated fingerprints: equal, or one apart
        same, apart = (0.5, 0.5) if self.bits == 1 else (0.375, 0.5)
        while n * same**k * (1 + self.reach * k * apart / same) > 1 << self.crowd and k < size - self.most:
            k += 1
        agree = Cover.sampled(self.most, self.words, 1, k, bits=self.bits, reach=self.reach).meeting()
        tables = 1 if agree >= 1 else math.ceil(math.log(1 - self.recall) / math.log1p(-agree))
        return Cover.sampled(self.most, self.words, tables, k, bits=self.bits, reach=self.reach)

    def chunk(self) -> int:
        """Cells of up to four times the usual crowd are not dealt out."""
        return max(CHUNK, 4 << self.crowd)


def _as_words(column, words: int) -> np.ndarray:
    """Binary fingerprints of an Arrow column as rows of 64-bit words."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").reshape(-1, words).astype(_U)


def _as_binary(prints: np.ndarray) -> pa.Array:
    raw, width = prints.astype(">u8").tobytes(), prints.shape[1] * 8
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


# ------------------------------------------------------------------------------- links


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits the rows of a and b differ in, word by word."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def _near(cover: Cover, a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> np.ndarray:
    """Which rows of a and b are linked: first by the Manhattan bound, then exactly."""
    near = _bits(counts_a, counts_b) <= cover.most
    if cover.bits > 1 and near.any():
        at = np.nonzero(near)
        a, b = np.broadcast_arrays(a, b)
        near[at] = _bits(a[at], b[at]) <= cover.most
    return near


def _forest(cover: Cover, prints: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a large tile: members and the first member of their component, instead of all linked pairs.  One of a pair is in its own cell."""
    order = np.argsort(~own, kind="stable")
    n, homes, prints = len(prints), int(own.sum()), np.asfortranarray(prints[order])
    counts = np.asfortranarray(cover.counts(prints))
    near = np.zeros((homes, n), bool)
    for at in range(0, homes, 64):
        rows, rest = slice(at, min(at + 64, homes)), slice(at, n)
        near[rows, rest] = _near(cover, prints[rows, None], prints[None, rest], counts[rows, None], counts[None, rest])
    a, b = np.nonzero(near)
    a, b = order[a], order[b]
    linked, at = np.unique(np.concatenate([a[a != b], b[a != b]]), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(linked))
    while True:
        least, less = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(least, a, less)
        np.minimum.at(least, b, less)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(linked)))
    return linked[moved], linked[label[moved]]


def _links_of(cover: Cover, tiles: np.ndarray, prints: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of whole tiles, one of each two in its own cell; ``tiles`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(tiles)]]))
    left, right = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    ids = np.flatnonzero(small)
    t, p, o = tiles[ids], prints[ids], own[ids]
    counts = cover.counts(p)
    for d in range(1, min(_SMALL, len(ids))):
        same = t[d:] == t[:-d]
        at = np.flatnonzero(same & (o[d:] | o[:-d]))
        if not same.any():
            break
        at = at[_near(cover, p[at], p[at + d], counts[at], counts[at + d])]
        left.append(ids[at])
        right.append(ids[at + d])
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        a, b = _forest(cover, prints[start : start + size], own[start : start + size])
        left.append(start + b)
        right.append(start + a)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(prints: DataFrame, cover: Cover, space: Workspace, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges between distinct fingerprints that join what links within ``cover.most`` bits join.

    ``prints`` has distinct ``fingerprint``s.  Every linked pair that meets in a cell is
    in one component of the edges; neither all pairs nor all links are given.  Cells are
    counted first, and those with one fingerprint, or with none whose own cell it is, go.
    A large cell is dealt out in chunks, one of its fingerprints to all of them, and the
    components of the links within chunks are found.  That settles cells whose members are
    all in one component.  In the others the members of the largest component stay in
    their chunks, and only the rest, in every chunk, are held against them.
    """

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                marks = part.column(1).to_numpy(zero_copy_only=False)
                rows, cells, own = zip(*cover.cells(_as_words(part.column(0), cover.words)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells).view(np.int64)), pa.array(marks[np.concatenate(rows)]), pa.array(np.repeat(own, [len(r) for r in rows]))], ["cell", "mark", "own"]
                )

    def find(batches):
        held_t, held_p, held_o = np.zeros(0, np.int64), np.zeros((0, cover.words), _U), np.zeros(0, bool)

        def result(t, p, o):
            a, b = _links_of(cover, t, p, o)
            return pa.RecordBatch.from_arrays([_as_binary(p[a]), _as_binary(p[b])], ["a", "b"])

        for batch in batches:
            t = np.concatenate([held_t, batch.column(0).to_numpy(zero_copy_only=False)])
            p = np.concatenate([held_p, _as_words(batch.column(1), cover.words)])
            o = np.concatenate([held_o, batch.column(2).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(t != t[-1], False)) if len(t) else 0
            held_t, held_p, held_o = t[whole:], p[whole:], o[whole:]
            if whole:
                yield result(t[:whole], p[:whole], o[:whole])
        if len(held_t):
            yield result(held_t, held_p, held_o)

    def linked(dealt: DataFrame) -> DataFrame:
        """Edges within tiles of rows that have an array of ``tiles`` each."""
        tiles = dealt.select(F.explode("tiles").alias("tile"), "fingerprint", "own").repartition("tile").sortWithinPartitions("tile", "fingerprint")
        return tiles.mapInArrow(tidy(find), "a binary, b binary").distinct()

    # rows of the cells are two numbers; fingerprints come back for those that meet another
    marked = prints.select("fingerprint", F.xxhash64("fingerprint").alias("mark"))
    cells = space.table(marked.mapInArrow(tidy(spread), "cell long, mark long, own boolean"), "cells")
    n = F.col("n")
    shared = cells.groupBy(F.col("cell").alias("at")).agg(F.count("*").alias("n"), F.min("mark").alias("least"), F.max("own").alias("home")).filter("n > 1 AND home")
    split = F.when(n <= chunk, 1).otherwise(F.ceil(n / F.greatest(F.lit(chunk), F.ceil(8 * F.sqrt(n))))).cast("int")
    met = cells.join(shared, cells["cell"] == shared["at"]).select("cell", "mark", "own", split.alias("split"), (F.col("mark") == F.col("least")).alias("central"))
    met = met.join(marked.withColumnRenamed("mark", "of"), F.col("mark") == F.col("of")).select("cell", "fingerprint", "own", "split", "central")
    mine = F.array(F.xxhash64("cell", F.pmod(F.xxhash64(F.lit("chunk"), "fingerprint"), F.col("split")).cast("int")))
    every = F.transform(F.sequence(F.lit(0), F.col("split") - 1), lambda j: F.xxhash64("cell", j))
    near = space.table(linked(met.select("fingerprint", "own", F.when((F.col("split") > 1) & F.col("central"), every).otherwise(mine).alias("tiles"))), "near")
    roots = space.table(components(near, space), "roots")
    stars = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    large = met.filter("split > 1").join(roots, F.col("fingerprint") == roots["node"], "left").select("cell", "fingerprint", "own", "split", F.coalesce("root", "fingerprint").alias("part"))
    large = space.table(large, "large")
    parts = large.groupBy("cell", "part").agg(F.count("*").alias("n"))
    open_ = parts.groupBy(F.col("cell").alias("at")).agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    left = large.join(open_, large["cell"] == open_["at"]).select("fingerprint", "own", F.when(F.col("part") == F.col("largest"), mine).otherwise(every).alias("tiles"))
    across = space.table(linked(left), "across")
    space.drop("cells", "near", "large")
    return stars.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 3, cover: Cover | Sampling | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (binary), component_id.

    Fingerprints that differ in at most ``cover.most`` bits are linked (3 of 64 by
    default, every such pair); component_id is the smallest id that links reach, the
    row's own included.  Null and empty texts have the fingerprint zero, which is linked
    like any other.  Rows that repeat an id each have their own fingerprint.  A null id
    counts only where a component has no other, and component_id is then null.  Other
    columns are ignored, and a result named like the id has an underscore after it.  An
    empty table gives no row.

    Equal fingerprints are reduced to one by map-side aggregation before anything else.
    ``cover`` is by default one that misses no pair, fitted to the number of fingerprints.
    """
    words = cover.words if cover else 1
    space = Workspace(docs.sparkSession, "simhash")
    prints = space.table(fingerprints(docs, id_col, text_col, shingle_words=shingle_words, words=words), "prints")
    nodes = space.table(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes")
    chunk = CHUNK
    if cover is None:
        cover = Cover.exact(3, nodes.count())
    elif isinstance(cover, Sampling):
        cover, chunk = cover.cover(nodes.count()), cover.chunk()
    linked = components(links(nodes, cover, space, chunk), space)
    rooted = nodes.join(linked, nodes["fingerprint"] == linked["node"]).select("fingerprint", "root", "least")
    moved = space.table(with_least(rooted, "root", "least", "component_id").select(F.col("fingerprint").alias("node"), "component_id"), "moved")
    classes = nodes.join(moved, nodes["fingerprint"] == moved["node"], "left").select(F.col("fingerprint").alias("node"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(classes, prints["fingerprint"] == classes["node"]).select("id", "fingerprint", "component_id").toDF(id_col, *free([id_col], "fingerprint", "component_id"))
