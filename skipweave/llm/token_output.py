"""Best-fit-decreasing packing into id matrices, and their binary files (operator 10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, slices, texts_of
from .packing import PER_TASK, Piece, Window
from .word_tokens import END, VOCABULARY, worker_word_tokens

#: Ids that a task gathers before it packs them, largest first; what stays open is carried over to the next such lot.
LOT_TOKENS = 4 << 20


class CapacityTree:
    """A segment tree over free capacities 0..size: the number of open windows with each; finds the smallest that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def change(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.counts[node] += by
            node >>= 1

    def smallest_from(self, need: int) -> int | None:
        """The smallest free capacity of at least `need` that some window has."""
        node, counts = self.leaves + need, self.counts
        if counts[node]:
            return need
        while node > 1:
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


class BestFitDecreasing:
    """Packs lots of documents, the longest first, each into the open window with the least room that it fits in."""

    def __init__(self, capacity: int):
        self.capacity, self.tree = capacity, CapacityTree(capacity)
        self.open: list[list[Window]] = [[] for _ in range(capacity + 1)]

    def add(self, lot: list[Piece]) -> Iterator[Window]:
        rest = []
        for piece in lot:
            while len(piece) >= self.capacity:  # overlong documents are split, no id is lost
                full, piece = piece.cut(self.capacity)
                yield Window([full], self.capacity)
            if len(piece):
                rest.append(piece)
        rest.sort(key=len, reverse=True)
        for piece in rest:
            free = self.tree.smallest_from(len(piece))
            if free is None:
                window = Window()
            else:
                window = self.open[free].pop()
                self.tree.change(free, -1)
            window.add(piece)
            if window.fill == self.capacity:
                yield window
            else:
                self.open[self.capacity - window.fill].append(window)
                self.tree.change(self.capacity - window.fill, 1)

    def close(self) -> Iterator[Window]:
        for level in self.open:
            yield from level
            level.clear()


COLUMNS = "sequence_id long, n_tokens long, ids binary, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_ids binary"
SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary())])


def matrix_rows(windows: Iterator[Window], first: int, capacity: int, pad: int) -> Iterator[pa.RecordBatch]:
    """A row for each window: its padded row of the id matrix (unsigned 16-bit), the cumulative lengths of its pieces, and
    positions that start again at 0 with each piece (unsigned 16-bit; 0 in the padding)."""
    rows: list[tuple] = []
    for number, window in enumerate(windows, first):
        ids, positions = np.full(capacity, pad, "<u2"), np.zeros(capacity, "<u2")
        bounds = [0]
        for p in window.pieces:
            at = bounds[-1]
            own = np.frombuffer(p.ids, "<u4")
            if own.max(initial=0) > 65_535:
                raise ValueError("ids of 65,536 and more do not fit a matrix of 16-bit ids")
            ids[at : at + len(p)] = own
            positions[at : at + len(p)] = np.arange(len(p))
            bounds.append(at + len(p))
        rows.append((number, window.fill, ids.tobytes(), [p.doc_id for p in window.pieces], [p.start for p in window.pieces], bounds, positions.tobytes()))
        if len(rows) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def pack_matrices(docs: DataFrame, path: str = VOCABULARY, capacity: int = 4096, end: int = END, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, ids, doc_ids and doc_starts of its pieces, cu_seqlens, position_ids.

    docs: doc_id and text, other columns are left out. Documents are their text's ids and `end`; those longer than
    `capacity` are split without loss. A null text counts as an empty one; rows with equal or null ids are packed one by
    one; an empty table gives no row. Each task gathers lots of `lot_tokens` ids of its own partition; windows that a lot
    leaves open are open to the next. Nothing is shuffled. Ids of 65,536 and more, and a larger capacity, raise an error.
    """
    if capacity > 65_536:
        raise ValueError("positions beyond 65,535 do not fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = worker_word_tokens(path), BestFitDecreasing(capacity)

        def windows() -> Iterator[Window]:
            lot, size = [], 0
            for batch in slices(batches, 256):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    ids = memoryview(tokens.encode(text, end))
                    lot.append(Piece(doc_id, ids, 0, len(ids) // 4))
                    size += len(ids) // 4
                    if size >= lot_tokens:
                        yield from packer.add(lot)
                        lot, size = [], 0
            yield from packer.add(lot)
            yield from packer.close()

        yield from matrix_rows(windows(), TaskContext.get().partitionId() * PER_TASK, capacity, end)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


#: The files of a task, by what they hold: rows of the id matrix (unsigned 16-bit), for each token a bit that tells
#: whether positions start again there (lowest bit first), cumulative lengths of pieces (32-bit, a leading 0 for each
#: row), and the pieces' documents (64-bit, NO_ID for none) and starts in them (64-bit).
FILES = ("ids", "resets", "cu_seqlens", "doc_ids", "doc_starts")
NO_ID = -(2**63)
#: Sequences that are read from the files at a time, and bytes of a file's part that is read for their pieces.
READ_ROWS = 256
READ_BYTES = 1 << 18


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of pack_matrices() to binary files below `folder`, which all executors must share, NAME.KIND for each
    kind of FILES; returns (name, first_sequence, n_rows, n_tokens, n_bounds).

    A task that is run again writes files of another name, and only files of the attempts that Spark accepted are in the
    returned list, which passes the driver, a row for each task. An empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        first = None
        rows = tokens = bounds = 0
        with ExitStack() as stack:
            files: dict = {}
            for batch in batches:
                if batch.num_rows and first is None:
                    where.create_dir(base, recursive=True)
                    files = {kind: stack.enter_context(where.open_output_stream(f"{base}/{name}.{kind}", compression=None)) for kind in FILES}
                    first = batch.column("sequence_id")[0].as_py()
                for ids, ends, doc_ids, starts, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"))):
                    resets = np.zeros(len(ids) // 2, np.uint8)
                    resets[ends[:-1]] = 1
                    files["ids"].write(ids)
                    files["resets"].write(np.packbits(resets, bitorder="little").tobytes())
                    files["cu_seqlens"].write(np.array(ends, "<i4").tobytes())
                    files["doc_ids"].write(np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes())
                    files["doc_starts"].write(np.array(starts, "<i8").tobytes())
                    rows, tokens, bounds = rows + 1, tokens + n, bounds + len(ends)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first, rows, tokens, bounds)], ["name", "first_sequence", "n_rows", "n_tokens", "n_bounds"])

    kind = "name string, first_sequence long, n_rows long, n_tokens long, n_bounds long"
    return packed.sparkSession.createDataFrame(packed.mapInArrow(run, kind).collect(), kind)


def read_binary(files: DataFrame, folder: str, n_files: int, capacity: int = 4096) -> DataFrame:
    """The rows that write_binary() wrote, as pack_matrices() gave them, from the files alone. Each file is read by one task
    in parts of READ_ROWS sequences; files that are too short or that disagree raise an error. n_files: for the number of
    tasks."""

    def exactly(stream, size: int) -> bytes:
        data = stream.read(size)
        if len(data) != size:
            raise ValueError("a file ends within a sequence")
        return data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(folder)
        for batch in batches:
            for name, first, n_rows, n_tokens in zip(*(batch.column(c).to_pylist() for c in ("name", "first_sequence", "n_rows", "n_tokens"))):
                with ExitStack() as stack:
                    ids, resets, lengths, doc_ids, starts = (stack.enter_context(where.open_input_stream(f"{base}/{name}.{kind}", compression=None)) for kind in FILES)
                    held, found = np.zeros(0, "<i4"), 0
                    for at in range(0, n_rows, READ_ROWS):
                        many = min(READ_ROWS, n_rows - at)
                        while (zeros := np.flatnonzero(held == 0)).size <= many and (more := lengths.read(READ_BYTES)):
                            held = np.r_[held, np.frombuffer(more, "<i4")]
                        cuts = [*zeros[: many + 1].tolist(), len(held)][: many + 1]
                        matrix = np.frombuffer(exactly(ids, 2 * capacity * many), "<u2").reshape(many, capacity)
                        marks = np.unpackbits(np.frombuffer(exactly(resets, -(-capacity // 8) * many), np.uint8).reshape(many, -1), axis=1, count=capacity, bitorder="little")
                        rows = []
                        for k in range(many):
                            bounds = held[cuts[k] : cuts[k + 1]]
                            begins = np.flatnonzero(marks[k])
                            if not np.array_equal(begins, bounds[:-1]):
                                raise ValueError("position resets and cumulative lengths disagree")
                            pieces = len(begins)
                            documents, begun = (np.frombuffer(exactly(f, 8 * pieces), "<i8").tolist() for f in (doc_ids, starts))
                            positions = np.zeros(capacity, "<u2")
                            positions[: bounds[-1]] = np.arange(bounds[-1]) - np.repeat(begins, np.diff(bounds))
                            found += int(bounds[-1])
                            rows.append((first + at + k, int(bounds[-1]), matrix[k].tobytes(), [None if d == NO_ID else d for d in documents], begun, bounds.tolist(), positions.tobytes()))
                        held = held[cuts[many] :]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                    if found != n_tokens:
                        raise ValueError("the files hold another number of tokens than was written")

    return files.repartition(max(1, n_files)).mapInArrow(run, COLUMNS)


def segments(packed: DataFrame) -> DataFrame:
    """A row for each piece of each sequence, with checksums of its sequence's ids and positions."""
    one = F.arrays_zip("doc_ids", "doc_starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("begins"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("ends"))
    rows = packed.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), F.posexplode(one).alias("segment", "p"))
    return rows.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_starts").alias("start"), (F.col("p.ends") - F.col("p.begins")).cast("long").alias("length"),
        "sequence_id", F.col("p.begins").cast("long").alias("offset"), "segment", F.col("n_tokens").alias("sequence_tokens"), "ids_crc32", "positions_crc32",
    )
