"""Vector bin packing of examples into training sequences.

An example needs room of several kinds at once: tokens, segments, and tokens that
bear loss. A sequence takes, again and again, the example whose needs point most in
the direction of the room it has left (the largest dot product), among those that
fit; when none fits and examples may be cut, it takes as much of one as it can hold.
Sequences are therefore full, unless segments or loss-bearing tokens ran out first.

Every partition packs its own examples, in windows of a bounded number, and carries
the open sequence from one window to the next; nothing is shuffled, so no source or
key can crowd a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import rows_in_pieces, tidy
from clubledger.llm.tokens import crc32_of_ids, encoder

#: Examples that compete for a sequence at one time.
WINDOW = 2048


@dataclass
class Limits:
    """The room of a sequence."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], dtype=float)


@dataclass
class Placed:
    """Part of an example in a sequence."""

    example: int
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """Packs examples given in windows; the open sequence stays open between them.

    An example is ``(tokens, segments, loss_tokens)``. With ``cut``, one that does
    not fit is cut; its loss-bearing tokens are taken to be its last ones, and each
    part counts as one segment at the least. Without, one larger than an empty
    sequence is an error.
    """

    def __init__(self, limits: Limits, cut: bool):
        self.full, self.cut = limits.array(), cut
        self.used = 0  # sequence numbers given away
        self.open: list[Placed] = []
        self._start()

    def _start(self) -> None:
        self.room, self.offset, self.sequence = self.full.copy(), 0, None

    def _number(self) -> int:
        self.used += 1
        return self.used - 1

    def _put(self, example: int, start: int, need: np.ndarray) -> None:
        if self.sequence is None:
            self.sequence = self._number()
        self.open.append(Placed(example, start, int(need[0]), self.sequence, self.offset))
        self.offset += int(need[0])
        self.room = self.room - need

    def _close(self) -> list[Placed]:
        done, self.open = self.open, []
        self._start()
        return done

    @staticmethod
    def _part(need: np.ndarray, room: np.ndarray) -> np.ndarray:
        """As much of an example as ``room`` holds, from its front."""
        tokens, segments, loss = need
        silent = tokens - loss
        taken = min(room[0], tokens, silent + room[2])
        if room[1] < 1 or taken < 1:
            return np.zeros(3)
        share = min(room[1], max(1.0, np.floor(segments * taken / tokens)))
        return np.array([taken, share, max(0.0, taken - silent)])

    @staticmethod
    def _take(needs: np.ndarray, starts: np.ndarray, i: int, part: np.ndarray) -> None:
        starts[i] += int(part[0])
        needs[i] = np.maximum(needs[i] - part, (0, needs[i, 0] > part[0], 0))

    def pack(self, needs: np.ndarray, first: int = 0) -> list[Placed]:
        """Places one window; returns what is in closed sequences by now. ``needs``:
        a row per example, where one without a token takes no place; the examples
        are numbered from ``first``."""
        needs, out = needs.astype(float), []
        starts = np.zeros(len(needs), dtype=np.int64)
        waiting = needs[:, 0] > 0
        if not self.cut and (needs[waiting] > self.full).any():
            raise ValueError("an example is larger than a sequence")
        for i in np.flatnonzero(waiting & (needs[:, 0] >= self.full[0])):
            # Full sequences of a long example; its rest competes with the others.
            while needs[i, 0] >= self.full[0]:
                part = self._part(needs[i], self.full)
                out.append(Placed(first + int(i), int(starts[i]), int(part[0]), self._number(), 0))
                self._take(needs, starts, i, part)
            waiting[i] = needs[i, 0] > 0
        pool = np.flatnonzero(waiting)
        while len(pool):
            own = needs[pool]
            fits = (own <= self.room).all(axis=1)
            towards = (own / self.full) @ (self.room / self.full)
            if fits.any():
                at = int(np.argmax(np.where(fits, towards, -1.0)))
                i = pool[at]
                self._put(first + int(i), int(starts[i]), needs[i].copy())
                pool = np.delete(pool, at)
            else:
                i = pool[int(np.argmax(towards))]
                part = self._part(needs[i], self.room) if self.cut else np.zeros(3)
                if part[0]:
                    self._put(first + int(i), int(starts[i]), part)
                    self._take(needs, starts, i, part)
                out += self._close()
            if self.room[0] < 1 or self.room[1] < 1:
                out += self._close()
        return out

    def finish(self) -> list[Placed]:
        """The last open sequence, cut where that avoids padding: into sequences whose
        lengths are powers of two."""
        if not self.cut:
            return self._close()
        out, left, done = [], self.offset, 0
        pieces = self._close()
        while left:
            length = 1 << (left.bit_length() - 1)
            number = pieces[0].sequence if not done else self._number()
            for p in pieces:
                low, high = max(p.offset, done), min(p.offset + p.length, done + length)
                if low < high:
                    start = p.start + low - p.offset
                    out.append(Placed(p.example, start, high - low, number, low - done))
            done, left = done + length, left - length
        return out


def _numbered(sequence: int) -> int:
    """A sequence number that no other partition gives."""
    return (TaskContext.get().partitionId() << 40) + sequence


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    limits: Limits | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text (none for a null) and ``end_id``, so
    every row of ``docs`` has a piece. All its tokens but the first bear loss. Ids
    of missing documents stay null, and repeated rows are packed each on its own.
    The last sequences of a partition, less than one full, have powers of two as
    lengths. Columns other than these two are not looked at.
    """
    limits = limits or Limits()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = narrow.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "long")

    def rows(placed: list[Placed], held: dict[int, tuple]) -> pa.RecordBatch:
        own = [held[p.example] for p in placed]
        columns = [
            [o[0] for o in own],
            [p.start for p in placed],
            [p.length for p in placed],
            [crc32_of_ids(o[1][p.start : p.start + p.length]) for o, p in zip(own, placed)],
            [len(o[1]) for o in own],
            [_numbered(p.sequence) for p in placed],
            [p.offset for p in placed],
        ]
        kinds = [held["type"], *[pa.int64()] * 6]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer), Packer(limits, cut=True)
        held: dict = {}
        first = 0  # number of the window's first document
        for whole in batches:
            held["type"] = whole.column("doc_id").type
            for slab in rows_in_pieces(whole):
                for at in range(0, slab.num_rows, window):
                    batch = slab.slice(at, window)
                    ids = [
                        np.append(coder.ids(data), end_id).astype("<u4")
                        for data in coder.encode(batch.column("text").to_pylist())
                    ]
                    own = zip(batch.column("doc_id").to_pylist(), ids, strict=True)
                    held.update(enumerate(own, first))
                    sizes = np.array([len(x) for x in ids])
                    needs = np.stack([sizes, np.ones_like(sizes), sizes - 1], axis=1)
                    placed = packer.pack(needs, first)
                    yield rows(placed, held)
                    still_open = {p.example for p in packer.open}
                    held = {k: v for k, v in held.items() if k == "type" or k in still_open}
                    first += batch.num_rows
        if packer.open:
            yield rows(packer.finish(), held)

    return narrow.mapInArrow(tidy(pack), schema)


def pack_examples(
    examples: DataFrame,
    limits: Limits,
    example_id: str,
    tokens: str = "tokens",
    segments: str = "segments",
    loss_tokens: str = "loss_tokens",
    window: int = WINDOW,
) -> DataFrame:
    """``(example_id, sequence_id, offset, length)`` of whole examples, for data such
    as instructions whose examples must not be cut.

    A null need counts as zero; an example without a token has no place. One larger
    than a sequence is an error. Other columns are not looked at.
    """
    needs = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c in (
        tokens, segments, loss_tokens)]
    narrow = examples.select(
        F.col(example_id).alias("example_id"),
        *[n.alias(a) for n, a in zip(needs, ("t", "s", "l"), strict=True)],
    )
    schema = narrow.select("example_id").schema
    for name in ("sequence_id", "offset", "length"):
        schema = schema.add(name, "long")

    def rows(placed: list[Placed], held: dict, kind: pa.DataType) -> pa.RecordBatch:
        columns = [
            pa.array([held[p.example] for p in placed], kind),
            pa.array([_numbered(p.sequence) for p in placed], pa.int64()),
            pa.array([p.offset for p in placed], pa.int64()),
            pa.array([p.length for p in placed], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, first, kind = Packer(limits, cut=False), {}, 0, pa.null()
        for whole in batches:
            kind = whole.column("example_id").type
            for at in range(0, whole.num_rows, window):
                batch = whole.slice(at, window)
                held.update(enumerate(batch.column("example_id").to_pylist(), first))
                own = np.stack([batch.column(c).to_numpy() for c in ("t", "s", "l")], axis=1)
                yield rows(packer.pack(own, first), held, kind)
                still_open = {p.example for p in packer.open}
                held = {k: v for k, v in held.items() if k in still_open}
                first += batch.num_rows
        if packer.open:
            yield rows(packer.finish(), held, kind)

    return narrow.mapInArrow(tidy(pack), schema)
