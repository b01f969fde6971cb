"""Byte-level BPE encoding and decoding as automata (operator 9)."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces, Transducer, Vocabulary, joined
from .common import joined_lists, kept

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Utf8Stream:
    """Turns chunks of UTF-8 bytes into text; between chunks it holds the bytes of an unfinished character (its state).

    Bytes that cannot be UTF-8 become U+FFFD, as in Python's "replace".
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that may begin a longer character."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            size = 2 if 0xC2 <= b <= 0xDF else 3 if b & 0xF0 == 0xE0 else 4 if 0xF0 <= b <= 0xF4 else 1
            if size <= back:
                return 0
            if back > 1:  # the second byte has a range of its own after these
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                return back if low <= data[1 - back] <= high else 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary.from_ranks(path)
        self.transducer = Transducer(self.vocabulary)
        self.pieces = Pieces(self._piece, b"".join)
        v = self.vocabulary
        self.unreached = {b for b, i in v.tokens.items() if v.spine(i) is None}
        self.bytes_by_id = pa.array([v.bytes_of.get(i) for i in range(max(v.bytes_of) + 1)], pa.large_binary())

    def _piece(self, piece: bytes) -> bytes:
        whole = self.vocabulary.tokens.get(piece)  # a piece that is a token is that token, whether or not merges reach it
        return struct.pack("<i", whole) if whole is not None else self.transducer.encode(piece)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self.pieces.each(text)

    #: Bytes of the pieces that encode_all() takes side by side, at most; the others go one by one.
    LONGEST = 64

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null counts as empty. Texts are cut before spaces, as by Pieces, and equal parts are encoded once."""
        texts = texts.fill_null("").cast(pa.large_string())
        data, bounds = _bytes_of(texts)
        if bounds[0] == bounds[-1]:
            return joined_lists([b""] * len(texts), 4, pa.int32())
        low = bounds[0]
        cut = np.append(data[low : bounds[-1]] == 0x20, True)
        cut[bounds - low] = True
        every = low + np.flatnonzero(cut)
        parts = _parts(texts, every)
        alone = np.zeros(len(parts.dictionary), bool)
        wrong = _cut_wrongly(parts.dictionary)
        if wrong.any():  # texts with white space next to a space are one part each
            whole = np.unique(np.searchsorted(bounds, every[:-1][wrong[parts.indices.to_numpy()]], side="right") - 1)
            for start, end in zip((bounds[whole] - low).tolist(), (bounds[whole + 1] - low).tolist()):
                cut[start + 1 : end] = False
            every = low + np.flatnonzero(cut)
            parts = _parts(texts, every)
            alone = np.zeros(len(parts.dictionary), bool)
            alone[parts.indices.to_numpy()[np.searchsorted(every, bounds[whole])]] = True
        per_text = np.diff(np.searchsorted(every, bounds))
        return joined(self._encode_parts(parts.dictionary, alone), parts.indices.to_numpy(), per_text)

    def _encode_parts(self, parts: pa.Array, alone: np.ndarray) -> pa.ListArray:
        """The ids of each part. Those that begin with a space are split into pieces together, but for those to go alone."""
        data, bounds = _bytes_of(parts)
        together = (data[bounds[:-1]] == 0x20) & ~alone
        high = np.maximum.reduceat(data[: bounds[-1]], bounds[:-1]) >= 0x80
        order, pieces, counts = [], [], []
        for group in (together & ~high, together & high):
            which = np.flatnonzero(group)
            if which.size:
                text, starts = _bytes_of(parts.take(pa.array(which)))
                found = pa.array(self.pieces.pieces(text[starts[0] : starts[-1]].tobytes().decode()), pa.large_string())
                text, starts = _bytes_of(found)
                first = np.flatnonzero(text[starts[:-1]] == 0x20)
                order.append(which)
                pieces.append(found)
                counts.append(np.diff(np.append(first, len(found))))
        which = np.flatnonzero(~together)
        if which.size:
            found = [self.pieces.pieces(s) for s in parts.take(pa.array(which)).to_pylist()]
            order.append(which)
            pieces.append(pa.array([p for ps in found for p in ps], pa.large_string()))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        places = np.empty(len(parts), np.int64)
        places[np.concatenate(order)] = np.arange(len(parts))
        ids, counts = self._encode_pieces(pa.concat_arrays(pieces)), np.concatenate(counts)
        return joined(joined(ids, np.arange(len(ids)), counts), places)

    def _encode_pieces(self, pieces: pa.Array) -> pa.ListArray:
        distinct = pieces.dictionary_encode()
        data, bounds = _bytes_of(distinct.dictionary)
        sizes = np.diff(bounds)
        one_by_one = sizes > self.LONGEST
        if self.unreached:
            one_by_one |= np.array([p.encode() in self.unreached for p in distinct.dictionary.to_pylist()])
        ids = self.transducer.encode_many(data, bounds[:-1], np.where(one_by_one, 0, sizes))
        if one_by_one.any():
            which = np.flatnonzero(one_by_one)
            own = [self._piece(p.encode()) for p in distinct.dictionary.take(pa.array(which)).to_pylist()]
            places = np.arange(len(ids))
            places[which] = len(ids) + np.arange(len(which))
            ids = joined(pa.concat_arrays([ids, joined_lists(own, 4, pa.int32())]), places)
        return joined(ids, distinct.indices.to_numpy())

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        if isinstance(ids, np.ndarray):
            found = self.bytes_by_id.take(pa.array(ids))
            if found.null_count:
                raise KeyError("no token has one of the ids")
            data, bounds = _bytes_of(found)
            return data[bounds[0] : bounds[-1]].tobytes()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], chunk: int = 16_384) -> Iterator[str]:
        """The text of the ids, in parts, from `chunk` tokens at a time."""
        stream = Utf8Stream()
        if isinstance(ids, np.ndarray):
            held = (ids[at : at + chunk] for at in range(0, len(ids), chunk))
        else:
            held = iter(lambda it=iter(ids): list(islice(it, chunk)), [])
        for part in held:
            yield stream.feed(self.decode_bytes(part))
        yield stream.close()


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of a large string array, and where in it each string begins and the last one ends."""
    _, bounds, data = strings.buffers()
    bounds = np.frombuffer(bounds, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def _parts(texts: pa.Array, every: np.ndarray) -> pa.DictionaryArray:
    """The texts' bytes cut at `every`, as a dictionary of the distinct parts."""
    return pa.Array.from_buffers(pa.large_string(), len(every) - 1, [None, pa.py_buffer(every), texts.buffers()[2]]).dictionary_encode()


def _cut_wrongly(parts: pa.Array) -> np.ndarray:
    """Which parts are a space with nothing or white space after it: there the cut may change a piece."""
    data, bounds = _bytes_of(parts)
    starts, sizes = bounds[:-1], np.diff(bounds)
    after = data[np.minimum(starts + 1, len(data) - 1)]
    wrong = (sizes == 1) | (after <= 0x20)
    for k in np.flatnonzero((data[starts] == 0x20) & (sizes > 1) & np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))).tolist():  # where white space beyond ASCII begins
        wrong[k] = parts[k].as_py()[1].isspace()
    return wrong & (data[starts] == 0x20)


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def worker_codec(path: str) -> Codec:
    """codec(), for functions sent to workers: Spark's pickles copy what kept() returns, with an empty memory of its own for
    each task, but only name this function, so that the tasks of a worker share one codec."""
    return codec(path)


#: Bytes of texts that are encoded together.
SLICE_BYTES = 4 << 20


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, and of SLICE_BYTES of text where that is more than one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            within = int(np.searchsorted(ends, SLICE_BYTES + (ends[at - 1] if at else 0), side="right"))
            end = max(at + 1, min(at + rows, within))
            yield batch.slice(at, end - at)
            at = end


def encode_texts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text, and the text that streaming decoding of those ids gives.

    docs: doc_id and text, other columns are left out. A null text counts as an empty one: no ids, an empty text. Special
    strings are ordinary text. Rows with equal or null ids each give a row; an empty table gives none. Rows never leave
    their partition, and a batch holds 1,024 texts of SLICE_BYTES together at most, or one text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_codec(path)
        for batch in _slices(batches):
            ids = own.encode_all(batch.column("text"))
            values, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
            decoded = ["".join(own.decode_stream(values[a:b])) for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids, "decoded": pa.array(decoded, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")
