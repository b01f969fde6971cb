"""Sum-of-squares online packing of token ids into windows (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices, texts_of
from .word_tokens import END, VOCABULARY, worker_word_tokens

#: Sequences of one task are numbered from its partition's number times this.
PER_TASK = 1 << 33


@dataclass
class Piece:
    """Part of a document: its ids, the ids of the document before it, and the ids of the whole document."""

    doc_id: int | None
    ids: memoryview
    start: int
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[: 4 * at], self.start, self.doc_tokens), Piece(self.doc_id, self.ids[4 * at :], self.start + at, self.doc_tokens)


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    fill: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece)


class SumOfSquares:
    """Online packing. N[h] counts the open windows that are filled to h; a document goes to the level (or to a new
    window) that leaves the smallest sum of N[h] squared over 0 < h < capacity. Ties go to the fullest window."""

    def __init__(self, capacity: int = 4096):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(capacity + 1)]

    def level_for(self, size: int) -> int:
        n, top = self.levels, self.capacity - size
        before, after = n[: top + 1], n[size:]
        # moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h] + 1); half of that is compared
        change = after - before + 1.0
        change[top] = 0.5 - before[top]  # a full window leaves the sum
        change[0] = after[0] + 0.5 if top else 0.0  # a new window only adds
        change[1:][before[1:] == 0] = np.inf
        return top - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> Iterator[Window]:
        """Places a document; yields the windows that it fills."""
        while len(piece) >= self.capacity:
            full, piece = piece.cut(self.capacity)
            yield Window([full], self.capacity)
        if size := len(piece):
            level = self.level_for(size)
            window = self.open[level].pop() if level else Window()
            self.levels[level] -= level > 0
            window.add(piece)
            if window.fill == self.capacity:
                yield window
            else:
                self.open[window.fill].append(window)
                self.levels[window.fill] += 1

    def close(self) -> Iterator[Window]:
        """The open windows: the fullest are filled up with ids cut from the emptiest; what then is left fills windows
        of decreasing powers of two, which need no padding."""
        windows = [w for level in self.open[::-1] for w in level]
        first, last = 0, len(windows) - 1
        while first < last:
            window, source = windows[first], windows[last]
            while window.fill < self.capacity and source.pieces:
                piece = source.pieces.pop()
                gap = self.capacity - window.fill
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    source.pieces.append(rest)
                source.fill -= len(piece)
                window.add(piece)
            last -= not source.pieces
            if window.fill == self.capacity:
                yield window
                first += 1
        if first == last:
            left = windows[first]
            for bit in range(left.fill.bit_length() - 1, -1, -1):
                if left.fill >> bit & 1:
                    part = Window()
                    while part.fill < 1 << bit:
                        piece = left.pieces.pop()
                        gap = (1 << bit) - part.fill
                        if len(piece) > gap:
                            piece, rest = piece.cut(gap)
                            left.pieces.append(rest)
                        part.add(piece)
                    yield part


COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def window_rows(windows: Iterator[Window], first: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece of the windows, which are numbered from `first`."""
    rows: list[tuple] = []
    size = 0
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for number, window in enumerate(windows, first):
        offset = 0
        for p in window.pieces:
            rows.append((p.doc_id, p.start, len(p), bytes(p.ids), p.doc_tokens, number, offset))
            offset += len(p)
        size += 4 * window.fill
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = 4096, end: int = END) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset; docs: doc_id and text, other columns are left out.

    Each document is its text's ids and `end`; a null text counts as an empty one, so every row gives a piece, and rows
    with equal or null ids are packed one by one. A table without rows gives none. Each task packs its own partition as it
    streams by, holding the open windows only (one for each level and a few more); nothing is shuffled, and a task that
    is run again packs the same rows again. Sequences are full, or as long as a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = worker_word_tokens(path), SumOfSquares(capacity)

        def windows() -> Iterator[Window]:
            for batch in slices(batches, 256):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    ids = memoryview(tokens.encode(text, end))
                    yield from packer.add(Piece(doc_id, ids, 0, len(ids) // 4))
            yield from packer.close()

        yield from window_rows(windows(), TaskContext.get().partitionId() * PER_TASK)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def pieces(packed: DataFrame) -> DataFrame:
    """The rows of pack() with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
