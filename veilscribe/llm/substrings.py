"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A window of words that occurs twice is a repeat.  The suffixes taken into trees are
those that start at anchors: in each window the run of ``window - 8`` words with the
least hash is its anchor, so that equal windows have equal anchors at equal places.  A
window is then a suffix's first words, its right part, and up to eight words before it,
its left part.

1. Documents are written as blocks, with their words as numbers of the block's own
   vocabulary.  Anchors seen once in the corpus rule their windows out.
2. The suffixes at the other anchors are dealt out by prefixes of variable length.  A
   prefix of one word is extended word by word as long as its suffixes would not fit
   into a task's memory; where the whole anchor does not do, its windows are dealt out
   one by one.
3. A task has the suffixes of some prefixes as word sequences.  Sorted, with the lengths
   of the prefixes that neighbours share, they are a suffix tree, and so are the left
   parts read backwards.  Leaves that share a node of depth r to the right and one of
   depth l to the left repeat l + r words; those with ``window`` words are deep.  The
   first leaf of a deep node in the order of the corpus stays, the others repeat it.
4. Windows that repeat one place after another are joined to maximal repeats.

Hashes only propose: nothing is called equal before its words were compared.  Between
the steps packed arrays move, one for each block and prefix group.  Equal windows of a block are one
before they are dealt out, so a passage in a third of all documents counts once for
each block.
"""

from __future__ import annotations

import io
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm.store import Workspace, free, get, groups, put, tidy

_WORD = re.compile(rb"[^\x20\x09-\x0D]+\x20*[\x09-\x0D\x20]*")
#: Text in a block, about, unless one document has more; documents in it at most; blocks that a task takes one after another.
BLOCK_BYTES, BLOCK_DOCS, TASK_BLOCKS = 8_000_000, 32_768, 64
#: Suffixes that a group should hold, and classes that the first word of a prefix is dealt into.
TASK_SUFFIXES, FIRST_CLASSES = 200_000, 1024
#: Places that an anchor may have in a window.
PLACES = 9
_U = np.uint64
_MULTIPLIER = _U(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


# ------------------------------------------------------------------- hashes of word runs


def word_hash(word: bytes) -> int:
    """Proposes equal words; nothing rests on it."""
    return xxhash.xxh3_64_intdigest(word)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _joined(values: np.ndarray, length: int, join) -> np.ndarray:
    """What ``join`` makes of each run of ``length`` values, from ever longer runs; it need not commute."""
    size, out, done = 1, None, 0
    while True:
        if length & size:
            out = values if out is None else join(out[: len(values) - done], values[done:])
            done += size
        if done == length:
            return out
        values = join(values[:-size], values[size:])
        size *= 2


def run_hashes(words: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, given those of the words."""
    if len(words) < length:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        return _joined(_mix(words + _U(salt)), length, lambda a, b: _mix(a * _MULTIPLIER + b))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, where its least one is; the first of equals."""
    return _joined(np.arange(len(values)), width, lambda a, b: np.where(values[b] < values[a], b, a))


def places(window: int) -> int:
    """How many places an anchor may have in a window; it is ``window - places + 1`` words long."""
    return max(1, min(PLACES, (window + 1) // 2))


# -------------------------------------------------------------------------------- blocks


class _Numbers(dict):
    """Word to its number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Block:
    """The words of a block's documents, in the order of the corpus.

    ``words`` has their numbers in ``vocabulary``, ``lengths`` the words of each document,
    ``anchors`` the places of the anchors, and ``windows`` for each anchor the windows it
    is in: bit k for the one that starts k words before it.
    """

    def __init__(self, words: np.ndarray, vocabulary: list[bytes], lengths: np.ndarray, ids: np.ndarray, window: int):
        self.words, self.vocabulary, self.lengths, self.ids, self.window = words, vocabulary, lengths, ids, window
        self.ends = np.cumsum(lengths)

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self.vocabulary), _U, len(self.vocabulary))

    @classmethod
    def of(cls, texts, ids: np.ndarray, window: int) -> Block:
        numbers = _Numbers()
        look, parts, lengths = numbers.__getitem__, [np.zeros(0, np.uint32)], []
        for text in texts:
            found = text.encode().split() if text else []
            lengths.append(len(found))
            parts.append(np.fromiter(map(look, found), np.uint32, len(found)))
        block = cls(np.concatenate(parts), list(numbers), np.array(lengths, np.int64), ids, window)
        block._anchor()
        return block

    def _anchor(self) -> None:
        n, places_, window = len(self.words), places(self.window), self.window
        self.anchors, self.windows = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        if n >= window:
            runs = run_hashes(self.hashes[self.words], window - places_ + 1, 3)
            start = np.flatnonzero(np.arange(n) + window <= np.repeat(self.ends, self.lengths))
            at = leftmost_least(runs, places_)[start]
            if len(at):
                # windows in a row have anchors in a row
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                self.anchors = at[first]
                self.windows = np.add.reduceat(1 << (at - start), first).astype(np.uint16)

    def to_bytes(self) -> bytes:
        small = self.words.astype(np.uint16) if len(self.vocabulary) <= 1 << 16 else self.words
        np.savez(out := io.BytesIO(), words=small, vocabulary=np.frombuffer(b" ".join(self.vocabulary), np.uint8), lengths=self.lengths, ids=self.ids, anchors=np.diff(self.anchors, prepend=0).astype(np.uint32), windows=self.windows, window=self.window)
        return zstandard.ZstdCompressor(1).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as held:
            block = cls(held["words"].astype(np.int64), held["vocabulary"].tobytes().split(), held["lengths"], held["ids"], int(held["window"]))
            block.anchors, block.windows = np.cumsum(held["anchors"], dtype=np.int64), held["windows"]
        return block

    def prefix(self, at: np.ndarray, length: int, before: np.ndarray | None = None) -> np.ndarray:
        """Hashes of ``length`` words from each place on; ``before`` has those of one word less."""
        out = np.full(len(at), 17, _U) if before is None else before
        with np.errstate(over="ignore"):
            for k in range(0 if before is None else length - 1, length):
                out = _mix(out * _MULTIPLIER + self.hashes[self.words[at + k]])
        return out

    def anchor_hashes(self) -> np.ndarray:
        return self.prefix(self.anchors, self.window - places(self.window) + 1)

    def met(self, hashes: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Which anchors are in another block, given the hashes of those, or in two places of this one."""
        ordered = np.sort(hashes)
        return np.isin(hashes, np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], elsewhere]))

    def heads(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of the chosen anchors, the first of each word sequence: anchors and windows left.  And the starts of the others, with the first start of each."""
        at, bits = self.anchors[chosen], self.windows[chosen].copy()
        owner, k = _bits_of(bits)
        start = at[owner] - k
        order = np.argsort(start)
        start, owner, k = start[order], owner[order], k[order]
        hashes = run_hashes(self.hashes[self.words], self.window, 11)[start] if len(start) else np.zeros(0, _U)
        order = np.argsort(hashes, kind="stable")
        fresh = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.zeros(0, bool)
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        again = order != first
        later, earlier = order[again], first[again]
        same = np.ones(len(later), bool)
        for j in range(self.window):
            same &= self.words[start[later] + j] == self.words[start[earlier] + j]
        later, earlier = later[same], earlier[same]
        np.bitwise_and.at(bits, owner[later], ~(np.uint16(1) << k[later].astype(np.uint16)))
        left = bits > 0
        sort = np.argsort(start[later])
        return at[left], bits[left], start[later][sort], start[earlier][sort]

    def contexts(self, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """For each anchor the words that its windows cover, plus one: ``window`` from it on and those before it, backwards; 0 elsewhere."""
        w, p = self.window, places(self.window)
        most = np.frexp(bits.astype(float))[1] - 1
        least = np.frexp((bits & -bits.astype(np.int32)).astype(float))[1] - 1
        out = np.zeros((w + p - 1, len(at)), np.int64)
        last = len(self.words) - 1
        for k in range(w):
            out[k] = np.where(k < w - least, self.words[np.minimum(at + k, last)] + 1, 0)
        for k in range(1, p):
            out[w + k - 1] = np.where(k <= most, self.words[np.maximum(at - k, 0)] + 1, 0)
        return out


def _bits_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each set bit."""
    found = [np.flatnonzero(bits >> np.uint16(k) & np.uint16(1)) for k in range(16)]
    return np.concatenate(found), np.repeat(np.arange(16), [len(x) for x in found])


# ------------------------------------------------------------------------------ prefixes


class Prefixes:
    """A tree of variable-length prefixes: what its leaves hold should fit into a task.

    A node of depth k stands for prefixes of k words, dealt into its parent's classes by
    hash.  Depth ``anchor + 1`` stands for whole windows.
    """

    def __init__(self, anchor: int, classes: int):
        self.anchor = anchor
        self.fan, self.child, self.depth = np.array([classes] + [0] * classes), np.array([1] + [0] * classes), np.array([0] + [1] * classes)

    def extend(self, sizes: dict[int, int], limit: int) -> bool:
        """Extends the leaves that hold more than ``limit``; whether there were any."""
        heavy = np.array([node for node, n in sorted(sizes.items()) if n > limit and not self.fan[node] and self.depth[node] <= self.anchor], np.int64)
        if not len(heavy):
            return False
        fan = np.array([min(4096, 2 * -(-sizes[node] // limit)) for node in heavy.tolist()])
        self.fan[heavy], self.child[heavy] = fan, len(self.fan) + np.cumsum(fan) - fan
        more = np.zeros(int(fan.sum()), np.int64)
        self.fan, self.child, self.depth = np.append(self.fan, more), np.append(self.child, more), np.append(self.depth, np.repeat(self.depth[heavy] + 1, fan))
        return True

    def deal(self, block: Block, at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, anchor and windows of each suffix; suffixes of spent prefixes are dealt out window by window."""
        node, hashes, open_ = np.zeros(len(at), np.int64), None, np.arange(len(at))
        for depth in range(1, self.anchor + 1):
            hashes = block.prefix(at[open_], depth, hashes)
            node[open_] = self.child[node[open_]] + (hashes % self.fan[node[open_]].astype(_U)).astype(np.int64)
            on = self.fan[node[open_]] > 0
            open_, hashes = open_[on], hashes[on]
            if not len(open_):
                return node, at, bits
        owner, k = _bits_of(bits[open_])
        owner = open_[owner]
        hashes = block.prefix(at[owner] - k, block.window)
        spent = self.child[node[owner]] + (hashes % self.fan[node[owner]].astype(_U)).astype(np.int64)
        rest = self.fan[node] == 0
        return np.concatenate([node[rest], spent]), np.concatenate([at[rest], at[owner]]), np.concatenate([bits[rest], np.uint16(1) << k.astype(np.uint16)])

    def groups(self, sizes: dict[int, int], limit: int) -> np.ndarray:
        """Node to group: neighbouring leaves together, up to about ``limit``."""
        counts = np.zeros(len(self.fan), np.int64)
        counts[list(sizes)] = list(sizes.values())
        counts[self.fan > 0] = 0
        before = np.cumsum(counts) - counts
        return np.unique(before // limit, return_inverse=True)[1]


# --------------------------------------------------------------------------------- trees


class Tree:
    """The suffix tree of word sequences, one a column: their order, and the words that neighbours in it share."""

    def __init__(self, words: np.ndarray):
        depth, n = words.shape
        width = max(1, int(words.max(initial=0)).bit_length())
        keys = []
        for k in range(0, depth, 64 // width):
            key = np.zeros(n, _U)
            for row in words[k : k + 64 // width]:
                key = key << _U(width) | row.astype(_U)
            keys.append(key)
        self.order = np.lexsort(keys[::-1]) if keys else np.arange(n)
        self.shared, same = np.zeros(max(0, n - 1), np.int64), np.ones(max(0, n - 1), bool)
        for row in words:
            ordered = row[self.order]
            same &= ordered[1:] == ordered[:-1]
            self.shared += same

    def nodes(self, depth: int) -> np.ndarray:
        """For each leaf the node over it that has so many words."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.shared < depth)
        return out


def repeats(contexts: np.ndarray, bits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix, window and the suffix with the same window that comes first, for each window below a deep node but the first.

    Columns of ``contexts`` are suffixes in the order of the corpus, as ``Block.contexts`` gives them.
    """
    right, left = Tree(contexts[:window]), Tree(contexts[window:])
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(places(window)):
        some = np.flatnonzero(bits >> np.uint16(k) & np.uint16(1))
        if len(some) < 2:
            continue
        # l words to the left and window - l to the right
        deep = right.nodes(window - k)[some] * (contexts.shape[1] + 1) + left.nodes(k)[some]
        _, first, of = np.unique(deep, return_index=True, return_inverse=True)
        first = some[first[of]]
        again = np.flatnonzero(first != some)
        found.append((some[again], np.full(len(again), k), first[again]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ------------------------------------------------------------------------- packed arrays


def _packed(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as bytes; those of 8-byte type as differences."""
    raw = [np.diff(c, prepend=c.dtype.type(0)).tobytes() if c.dtype == np.int64 else c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(1).compress(b"".join(raw))


def _unpacked(data: bytes, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    for t in map(np.dtype, types):
        column = np.frombuffer(raw, t, n, at)
        out.append(np.cumsum(column) if t == np.int64 else column)
        at += n * t.itemsize
    return out


def _spelt(contexts: np.ndarray, vocabulary: list[bytes]) -> bytes:
    """Word sequences with the words themselves: each word used once, then the sequences in numbers of these."""
    used = np.unique(contexts) if contexts.size < 20_000 else np.flatnonzero(np.bincount(contexts.reshape(-1), minlength=1))
    used = used[used > 0]
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint32)
    number[used] = np.arange(1, len(used) + 1)
    codes = number[contexts].astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
    words = b" ".join([vocabulary[u - 1] for u in used.tolist()])
    return zstandard.ZstdCompressor(1).compress(len(words).to_bytes(8, "little") + codes.dtype.itemsize.to_bytes(1, "little") + words + codes.tobytes())


def _read_spelt(data: bytes, rows: int, numbers: _Numbers) -> np.ndarray:
    """The sequences that ``_spelt`` wrote, in numbers of ``numbers``, plus one."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    size, width = int.from_bytes(raw[:8], "little"), raw[8]
    words = raw[9 : 9 + size].split()
    known = np.zeros(len(words) + 1, np.int32)
    known[1:] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) + 1
    return known[np.frombuffer(raw, f"<u{width}", offset=9 + size)].reshape(rows, -1)


def _runs(keys: np.ndarray):
    """Key, start and end of each run of equal keys."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(keys[a]), a, b


def _sorted(table: pa.Table, id_col: str) -> pa.Table:
    """Rows by id, null ids last, equal ones as they came."""
    ids = table[id_col].cast(pa.int64())
    return table.take(pa.array(np.argsort(ids.fill_null(_LAST).to_numpy(), kind="stable")))


def _without(text: str, gone: np.ndarray) -> str:
    """The text without the words marked in ``gone`` and the space after each."""
    raw, out, at = text.encode(), [], 0
    for k, word in enumerate(_WORD.finditer(raw)):
        if gone[k]:
            out.append(raw[at : word.start()])
            at = word.end()
    out.append(raw[at:])
    return b"".join(out).decode()


_ROWS = "kind int, block long, part long, n long, data binary, more binary"
_ROW_TYPES = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
_BLOCK, _ANCHORS, _COUNT, _SUFFIXES, _REPEATS = range(5)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ROW_TYPES.types)], schema=_ROW_TYPES)


# ----------------------------------------------------------------------------- operators


class _Search:
    """The windows of a table's documents that start earlier, too."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int, task_suffixes: int, first_classes: int, sources: bool):
        if window < 2:
            raise ValueError("a window has two words at least")
        spark, space = docs.sparkSession, Workspace(docs.sparkSession, "substrings")
        self.uri, self.id_col, self.text_col, self.window, self.sources = space.folder("blocks"), id_col, text_col, window, sources
        uri, fields = self.uri, docs.columns
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = 1 << max(256, 4 * shuffles).bit_length() - 1
        shift = _U(64 - buckets.bit_length() + 1)

        def cut(batches):
            """Blocks of rows, in the order of reading."""
            held, size, count = [], 0, 0
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, fields)
                at = batch.schema.get_field_index(text_col)
                sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
                first = 0
                for k, n in enumerate(sizes.tolist()):
                    size, count = size + n, count + 1
                    if size >= block_bytes or count >= BLOCK_DOCS:
                        held.append(batch.slice(first, k + 1 - first))
                        yield pa.Table.from_batches(held)
                        held, size, count, first = [], 0, 0, k + 1
                if first < batch.num_rows:
                    held.append(batch.slice(first))
            if held:
                yield pa.Table.from_batches(held)

        def write(batches):
            task = TaskContext.get().partitionId()
            for number, table in enumerate(cut(batches)):
                name, table = (task << 32) + number, _sorted(table, id_col)
                out = io.BytesIO()
                with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                    file.write_table(table)
                put(f"{uri}/{name:020d}.arrow", out.getvalue())
                texts = chain.from_iterable(c.slice(k, 256).to_pylist() for c in table[text_col].chunks for k in range(0, len(c), 256))
                block = Block.of(texts, table[id_col].cast(pa.int64()).fill_null(_LAST).to_numpy(), window)
                put(f"{uri}/{name:020d}.words", block.to_bytes())
                rows = [(_BLOCK, name, 0, len(block.anchors), b"", None)]
                anchors = np.unique(block.anchor_hashes())
                low = (anchors & _U(0xFFFFFFFF)).astype(np.uint32)
                rows += [(_ANCHORS, name, p, b - a, low[a:b].tobytes(), None) for p, a, b in _runs((anchors >> shift).astype(np.int64))]
                yield _batch(rows)

        def meet(batches):
            """Anchors of a bucket that are in two blocks or more, for each of those."""
            for part, rows in groups(batches, "part"):
                lists = [np.frombuffer(x, np.uint32) for x in rows["data"].to_pylist()]
                values, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                order = np.argsort(values, kind="stable")
                same = values[order][1:] == values[order][:-1]
                shared = np.zeros(len(values), bool)
                shared[order[1:][same]] = True
                shared[order[:-1][same]] = True
                at = np.flatnonzero(shared)
                blocks = rows["block"].to_pylist()
                found = [(_ANCHORS, blocks[k], part, b - a, values[at[a:b]].tobytes(), None) for k, a, b in _runs(owner[at])]
                if found:
                    yield _batch(found)

        first = space.table(docs.mapInArrow(tidy(write), _ROWS), "first")
        self.blocks = first.filter(F.col("kind") == _BLOCK)
        n_blocks = max(1, self.blocks.count())
        self.tasks = min(n_blocks, max(4 * shuffles, -(-n_blocks // TASK_BLOCKS)))
        width = min(buckets, shuffles)
        anchors = first.filter(F.col("kind") == _ANCHORS)
        shared = anchors.repartitionById(width, (F.col("part") % width).cast("int")).sortWithinPartitions("part", "block").mapInArrow(tidy(meet), _ROWS)
        prefixes = Prefixes(window - places(window) + 1, first_classes)

        def heads(batches):
            """Writes a block's suffixes that may lie below a deep node, and counts them by their first words."""
            sizes = np.zeros(len(prefixes.fan), np.int64)
            for name, rows in groups(batches, "block"):
                block = Block.from_bytes(get(f"{uri}/{name:020d}.words"))
                elsewhere = [(_U(r["part"]) << shift, np.frombuffer(r["data"], np.uint32)) for r in rows.select(["kind", "part", "data"]).to_pylist() if r["kind"] == _ANCHORS]
                hashes = block.anchor_hashes()
                chosen = np.flatnonzero(block.met(hashes, _lookup(hashes, elsewhere, shift)))
                at, bits, later, earlier = block.heads(chosen)
                np.savez(side := io.BytesIO(), at=np.diff(at, prepend=0), bits=bits, later=np.diff(later, prepend=0), earlier=np.diff(earlier, prepend=0) if sources else earlier[:0])
                put(f"{uri}/{name:020d}.heads", zstandard.ZstdCompressor(1).compress(side.getvalue()))
                sizes += np.bincount(prefixes.deal(block, at, bits)[0], minlength=len(sizes))
            some = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_pydict({"node": some, "n": sizes[some]})

        def count(batches):
            sizes = np.zeros(len(prefixes.fan), np.int64)
            for name in _names(batches):
                block, at, bits, _, _ = _heads(uri, name)
                sizes += np.bincount(prefixes.deal(block, at, bits)[0], minlength=len(sizes))
            some = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_pydict({"node": some, "n": sizes[some]})

        def total(counts: DataFrame) -> dict[int, int]:
            """A number for each prefix that is in use, of which there are about as many as groups."""
            found = counts.groupBy("node").agg(F.sum("n").alias("n")).toArrow()
            return dict(zip(found["node"].to_pylist(), found["n"].to_pylist(), strict=True))

        by_block = self.blocks.unionByName(shared).repartition(self.tasks, "block").sortWithinPartitions("block")
        sizes = total(by_block.mapInArrow(tidy(heads), "node long, n long"))
        limit = max(1, min(task_suffixes, max(task_suffixes // 16, -(-sum(sizes.values()) // (2 * shuffles)))))
        while prefixes.extend(sizes, task_suffixes):
            sizes = total(self._names().mapInArrow(tidy(count), "node long, n long"))
        self.depth = int(prefixes.depth.max())
        group = prefixes.groups(sizes, limit)
        n_groups = int(group.max()) + 1

        def suffixes(batches):
            """The suffixes of each block by prefix group, with their words."""
            for name in _names(batches):
                block, at, bits, _, _ = _heads(uri, name)
                if not len(at):
                    continue
                node, at, bits = prefixes.deal(block, at, bits)
                part = group[node]
                order = np.lexsort((at, part))
                part, at, bits = part[order], at[order], bits[order]
                doc = np.searchsorted(block.ends, at, side="right")
                ids = block.ids[doc]
                place = at - (block.ends - block.lengths)[doc]
                out = []
                for p, a, b in _runs(part):
                    columns = [ids[a:b], at[a:b], *[place[a:b]] * sources, bits[a:b]]
                    out.append((_SUFFIXES, name, p, b - a, _spelt(block.contexts(at[a:b], bits[a:b]), block.vocabulary), _packed(*columns)))
                    if len(out) >= 64:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

        def trees(batches):
            """The windows of a group's suffixes that start earlier, by block."""
            rows_of, types = window + places(window) - 1, [np.int64, np.int64, *[np.int64] * sources, np.uint16]
            for part, rows in groups(batches, "part"):
                numbers, blocks = _Numbers(), np.array(rows["block"].to_pylist())
                contexts = np.concatenate([_read_spelt(x.as_py(), rows_of, numbers) for x in rows["data"]], axis=1)
                columns = [np.concatenate(c) for c in zip(*(_unpacked(x.as_py(), *types) for x in rows["more"]), strict=True)]
                ids, at, bits = columns[0], columns[1], columns[-1]
                owner = np.repeat(np.arange(len(blocks)), rows["n"].to_numpy())
                order = np.lexsort((at, blocks[owner], ids))
                contexts, bits, ids, at, owner = np.take(contexts, order, axis=1), bits[order], ids[order], at[order], owner[order]
                suffix, k, earlier = repeats(contexts, bits, window)
                start = at[suffix] - k
                by = np.lexsort((start, owner[suffix]))
                suffix, k, earlier, start = suffix[by], k[by], earlier[by], start[by]
                found = []
                for o, a, b in _runs(owner[suffix]):
                    where = _packed(ids[earlier[a:b]], (columns[2][order])[earlier[a:b]] - k[a:b]) if sources else None
                    found.append((_REPEATS, int(blocks[o]), part, b - a, _packed(start[a:b]), where))
                if found:
                    yield _batch(found)

        width = min(n_groups, max(shuffles, -(-n_groups // 8)))
        sent = self._names().mapInArrow(tidy(suffixes), _ROWS)
        self.found = sent.repartitionById(width, (F.col("part") % width).cast("int")).sortWithinPartitions("part", "block").mapInArrow(tidy(trees), _ROWS)

    def _names(self) -> DataFrame:
        return self.blocks.select("block").repartition(self.tasks, "block")

    def by_block(self) -> DataFrame:
        return self.blocks.unionByName(self.found).repartition(self.tasks, "block").sortWithinPartitions("block")


def _names(batches):
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _heads(uri: str, name: int) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block, the anchors and windows that are dealt out, and starts of windows that it has earlier, with those."""
    block = Block.from_bytes(get(f"{uri}/{name:020d}.words"))
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(get(f"{uri}/{name:020d}.heads")))) as side:
        return block, np.cumsum(side["at"]), side["bits"], np.cumsum(side["later"]), np.cumsum(side["earlier"])


def _lookup(hashes: np.ndarray, elsewhere: list[tuple[np.uint64, np.ndarray]], shift: np.uint64) -> np.ndarray:
    """The anchors of this block that the lists name by bucket and low bits.  The bits between are not looked at: what is named too much is told apart by its words."""
    if not elsewhere:
        return hashes[:0]
    named = np.concatenate([low.astype(_U) | top for top, low in elsewhere])
    own = np.unique(hashes)
    mask = _U((((1 << 64) - 1) >> int(shift) << int(shift)) | 0xFFFFFFFF)
    return own[np.isin(own & mask, named)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, block_bytes: int = BLOCK_BYTES, task_suffixes: int = TASK_SUFFIXES, first_classes: int = FIRST_CLASSES) -> DataFrame:
    """``docs`` with repeated passages taken out of the texts; added: n_words (before) and n_removed.

    Words are runs of characters other than space and U+0009 to U+000D.  A word goes if
    a window of ``window`` consecutive words of its document covers it whose sequence
    also starts earlier: in a document with a smaller id, or before it in its own.  What
    is earlier is judged on the input.  With a word goes the white space after it; texts
    that lose nothing stay as they are, and a null text stays null with 0 words.

    Ids are integers.  Null ids come after all others; rows that repeat an id are
    separate documents, those of one block in the order of reading, so that one of two
    equal rows keeps its text.  Other columns stay; if one is named like a result, the
    result has an underscore after it.  An empty table gives no row.

    Texts are not shuffled: blocks are files in the shared folder that later tasks read
    by name.
    """
    search = _Search(docs, id_col, text_col, window, block_bytes, task_suffixes, first_classes, False)
    uri = search.uri
    words_name, removed_name = free(docs.columns, "n_words", "n_removed")

    def clean(batches):
        for name, rows in groups(batches, "block"):
            with pa.ipc.open_file(pa.BufferReader(get(f"{uri}/{name:020d}.arrow"))) as file:
                table = file.read_all()
            block, _, _, own, _ = _heads(uri, name)
            ends, lengths, edge = block.ends, block.lengths, np.zeros(len(block.words) + 1, np.int64)
            starts = np.concatenate([own, *(_unpacked(r["data"], np.int64)[0] for r in rows.select(["kind", "data"]).to_pylist() if r["kind"] == _REPEATS)])
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(covered)])
            removed = before[ends] - before[ends - lengths]
            at = table.schema.get_field_index(text_col)
            for k in range(0, table.num_rows, 1024):
                part = table.slice(k, 1024)
                texts = part[text_col].to_pylist()
                for i in np.flatnonzero(removed[k : k + 1024]).tolist():
                    texts[i] = _without(texts[i], covered[ends[k + i] - lengths[k + i] : ends[k + i]])
                part = part.set_column(at, text_col, pa.array(texts, pa.string()))
                part = part.append_column(words_name, pa.array(lengths[k : k + 1024])).append_column(removed_name, pa.array(removed[k : k + 1024]))
                yield from part.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)
    return search.by_block().mapInArrow(tidy(clean), f"{schema}, `{words_name}` long, `{removed_name}` long")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, block_bytes: int = BLOCK_BYTES, task_suffixes: int = TASK_SUFFIXES, first_classes: int = FIRST_CLASSES) -> DataFrame:
    """The passages that ``remove_repeats`` takes out: id, start, length, first_id, first_start.

    A row says that ``length`` words of the document from its word ``start`` on are also
    those from word ``first_start`` of the document ``first_id`` on, where each window of
    them occurs for the first time in the corpus, and that the passage can be made longer
    at neither end.  Passages may overlap, with each other and with their own source.
    Null ids come last and are null again here; otherwise ids are as for
    ``remove_repeats``, and so are null and empty texts and the empty table.  A result
    named like the id has an underscore after it.
    """
    search = _Search(docs, id_col, text_col, window, block_bytes, task_suffixes, first_classes, True)
    uri = search.uri

    def join(batches):
        for name, rows in groups(batches, "block"):
            block, _, _, own, earlier = _heads(uri, name)
            begins = block.ends - block.lengths
            doc = np.searchsorted(block.ends, earlier, side="right")
            lists = [(own[:0], block.ids[:0], own[:0])]
            lists += [(_unpacked(r["data"], np.int64)[0], *_unpacked(r["more"], np.int64, np.int64)) for r in rows.select(["kind", "data", "more"]).to_pylist() if r["kind"] == _REPEATS]
            start, of, at = (np.concatenate(c) for c in zip(*lists, strict=True))
            order = np.argsort(start)
            start, of, at = start[order], of[order], at[order]
            # what is earlier in the block may be a repeat of another
            known = np.minimum(np.searchsorted(start, earlier), max(0, len(start) - 1))
            repeat = start[known] == earlier if len(start) else np.zeros(len(earlier), bool)
            own_of, own_at = block.ids[doc], earlier - begins[doc]
            own_of[repeat], own_at[repeat] = of[known[repeat]], at[known[repeat]]
            start, of, at = np.concatenate([start, own]), np.concatenate([of, own_of]), np.concatenate([at, own_at])
            order = np.argsort(start)
            start, of, at = start[order], of[order], at[order]
            doc = np.searchsorted(block.ends, start, side="right")
            on = (np.diff(start) == 1) & (np.diff(at) == 1) & (of[1:] == of[:-1]) & (doc[1:] == doc[:-1])
            head = np.flatnonzero(np.concatenate([[True], ~on])) if len(start) else start
            length = np.diff(np.concatenate([head, [len(start)]])) + window - 1

            def null_again(values):
                return pa.array(values, mask=values == _LAST)

            yield pa.RecordBatch.from_arrays([null_again(block.ids[doc[head]]), pa.array(start[head] - begins[doc[head]]), pa.array(length), null_again(of[head]), pa.array(at[head])], ["id", "start", "length", "first_id", "first_start"])

    found = search.by_block().mapInArrow(tidy(join), "id long, start long, length long, first_id long, first_start long")
    return found.toDF(id_col, *free([id_col], "start", "length", "first_id", "first_start"))
