"""Packing of examples into training sequences by vector bin packing.

A sequence has three limits at once: tokens, segments, and tokens that bear loss.  An
example's demand on each, as a share of the limit, is a vector; so is what a sequence
has left.  The next example placed is the one, of those that fit, whose demand has the
greatest dot product with what is left.  Where none fits, the longest is cut to fill.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscribe.llm import vocab
from veilscribe.llm.store import free, tidy

#: Examples that a task holds open to choose from.
POOL = 1024


class Piece:
    """A run of one example's ids: ``ids`` from ``start`` on, of which ``bare`` at the front bear no loss."""

    __slots__ = ("bare", "ids", "row", "start")

    def __init__(self, row, ids: np.ndarray, start: int, bare: int):
        self.row, self.ids, self.start, self.bare = row, ids, start, bare

    @property
    def loss(self) -> int:
        return len(self.ids) - self.bare

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.ids[:n], self.start, min(n, self.bare)), Piece(self.row, self.ids[n:], self.start + n, max(0, self.bare - n))


class Packer:
    """Packs a stream of pieces; what ``add`` and ``finish`` give are whole sequences, lists of pieces.

    Every sequence has ``length`` tokens or a power of two of them, so none is padded.
    """

    def __init__(self, length: int, max_segments: int, max_loss: int, pool: int = POOL):
        if min(length, max_segments, max_loss) < 1:
            raise ValueError("limits start at 1")
        self.pool = pool
        self.length, self.max_segments, self.max_loss = length, max_segments, max_loss
        self.pieces: list[Piece] = []
        # tokens and loss of each piece in the pool; its segments are always one
        self.demand = np.zeros((2, pool + 2 * max_segments + 2))
        self.tokens = 0

    def _put(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == self.demand.shape[1]:
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)], axis=1)
        self.demand[:, n] = len(piece.ids), piece.loss
        self.pieces.append(piece)
        self.tokens += len(piece.ids)

    def _take(self, k: int) -> Piece:
        piece, last = self.pieces[k], self.pieces.pop()
        if last is not piece:
            self.pieces[k] = last
            self.demand[:, k] = self.demand[:, len(self.pieces)]
        self.tokens -= len(piece.ids)
        return piece

    def add(self, piece: Piece):
        """Cut whole sequences off a long piece, put the rest into the pool, and pack the pool down if it is full."""
        while len(piece.ids) >= self.length or piece.loss > self.max_loss:
            head, piece = piece.cut(min(self.length, len(piece.ids), piece.bare + self.max_loss))
            if len(head.ids) == self.length:
                yield [head]
            else:
                self._put(head)
        if len(piece.ids):
            self._put(piece)
        while len(self.pieces) > self.pool:
            yield self._sequence()

    def finish(self):
        while self.pieces:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        room, segments, loss = self.length, self.max_segments, self.max_loss
        if self.tokens < self.length:
            room = 1 << (self.tokens.bit_length() - 1)
        chosen: list[Piece] = []
        while room and segments and self.pieces:
            tokens, bearing = self.demand[:, : len(self.pieces)]
            # every piece is one segment, which adds the same to each dot product; those that fit are above zero, as all have tokens
            score = tokens * (room / self.length**2)
            score += bearing * (loss / self.max_loss**2)
            score *= tokens <= room if segments > 1 else tokens == room
            score *= bearing <= loss
            k = int(score.argmax())
            if score[k]:
                piece = self._take(k)
            else:
                # the longest by what of it could go in
                goes = np.minimum(np.minimum(tokens, room), tokens - bearing + loss)
                k = int(goes.argmax())
                if not goes[k]:
                    break
                piece = self._take(k)
                n = min(len(piece.ids), room, piece.bare + loss)
                if n < len(piece.ids):
                    piece, rest = piece.cut(n)
                    self._put(rest)
            chosen.append(piece)
            room, segments, loss = room - len(piece.ids), segments - 1, loss - piece.loss
        used = sum(len(p.ids) for p in chosen)
        surplus = used - (self.length if used == self.length else 1 << (used.bit_length() - 1))
        while surplus:
            last = chosen.pop()
            if len(last.ids) > surplus:
                last, rest = last.cut(len(last.ids) - surplus)
                chosen.append(last)
                self._put(rest)
                break
            surplus -= len(last.ids)
            self._put(last)
        return chosen


def _prompt_ids(text: str, ids: np.ndarray, mark: str, sizes: np.ndarray) -> int:
    """How many ids at the front end within the text up to and with its first ``mark``; 0 without one."""
    end = text.find(mark)
    if end < 0:
        return 0
    end = len(text[: end + len(mark)].encode())
    return int(np.searchsorted(np.cumsum(sizes[ids[:end]]), end, side="right"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prompt_col: str | None = None, prompt_mark: str | None = None, vocabulary: str = vocab.DEFAULT_VOCABULARY, end_id: int = 0,
    length: int = 1024, max_segments: int = 64, max_loss: int = 1024, pool: int = POOL, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked for, ids.

    An example is the ids of its prompt, which bear no loss, then those of its text and
    ``end_id``, which do.  With ``prompt_mark`` those ids of the text bear none either that
    end before or with its first mark: with a line break the first line asks and the rest
    answers.  Null texts and prompts are empty, so that the least example
    is ``end_id`` alone.  A null id stays null; rows that repeat an id are packed one by one, and other columns are ignored, whatever their names; a result named like the
    id has an underscore after it.  An empty table gives no row.  ``ids`` are little-endian unsigned 32-bit.

    Examples may be cut anywhere; each id lies in one piece.  Sequences hold at most
    ``length`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens, and
    have ``length`` tokens or a power of two.  A task packs what it reads through a pool
    of bounded size, so there is no shuffle and a repeated task gives the same rows.
    """
    prompt = F.col(prompt_col) if prompt_col else F.lit(None)
    source = docs.select(F.col(id_col).alias("id"), prompt.cast("string").alias("prompt"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [id_col, *free([id_col], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", *["ids"] * with_ids)]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kind, *["long"] * 7, *["binary"] * with_ids], strict=True))

    def run(batches):
        encoder = vocab.encoder(vocabulary)
        packer, number = Packer(length, max_segments, max_loss, pool), TaskContext.get().partitionId() << 40
        end, sizes = np.array([end_id], encoder.dtype), np.array([len(b) for b in encoder.token_bytes])
        id_type, out = None, []

        def emit(sequence):
            nonlocal number
            offset = 0
            for p in sequence:
                ids = p.ids.astype("<u4").tobytes()
                out.append((p.row[0], p.start, len(p.ids), zlib.crc32(ids), p.row[1], number, offset, p.loss, ids))
                offset += len(p.ids)
            number += 1

        def full():
            types = [id_type, *[pa.int64()] * 7, *[pa.binary()] * with_ids]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, before, text in vocab.rows(batch, "id", "prompt", "text"):
                asked, own = encoder.ids(before or ""), encoder.ids(text or "")
                bare = len(asked) + (_prompt_ids(text or "", own, prompt_mark, sizes) if prompt_mark else 0)
                ids = np.concatenate([asked, own, end])
                for sequence in packer.add(Piece((i, len(ids)), ids, 0, bare)):
                    emit(sequence)
                    if len(out) >= 4096:
                        yield full()
        for sequence in packer.finish():
            emit(sequence)
            if len(out) >= 4096:
                yield full()
        if out:
            yield full()

    return source.mapInArrow(tidy(run), schema)
