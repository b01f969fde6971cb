"""Byte-pair encodings seen as automata.

A sequence of tokens is the encoding of its bytes exactly if each adjacent pair is the encoding of its own bytes
(`Vocabulary.follows`). So the last token of the encoding of a prefix is the only token that ends there and may follow
the last token of the prefix before it. `PrefixCounts` tabulates that recurrence over a trie of prefixes; `Transducer`
keeps only the part of it that later bytes can still change, as the state of a lazily determinised finite-state machine.
"""

from __future__ import annotations

import base64
import json
import struct
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import Memo, joined_lists

#: The pattern that byte-level vocabularies split text by before merging; fixed by their files' library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII letters, digits and marks.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which .json vocabularies write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, the order of merges, and which token may follow which.

    merges: (left id, right id) -> (order, merged id).
    """

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.bytes_of = tokens, {i: b for b, i in tokens.items()}
        self.merges = merges
        self.spines: dict[int, tuple | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        model, alphabet = json.loads(Path(path).read_text())["model"], byte_alphabet()
        read = lambda s: bytes(alphabet[c] for c in s)
        tokens = {read(s): i for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        merges = {}
        for order, (a, b) in enumerate(model["merges"]):
            merges.setdefault((tokens[read(a)], tokens[read(b)]), (order, tokens[read(a) + read(b)]))
        return cls(tokens, merges)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two neighbours whose bytes together are a token may merge, the lowest id first."""
        rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        tokens = {base64.b64decode(a): int(b) for a, b in rows}
        merges = {}
        for whole, order in tokens.items():
            for k in range(1, len(whole)):
                a, b = tokens.get(whole[:k]), tokens.get(whole[k:])
                if a is not None and b is not None:
                    merges[a, b] = (order, order)
        return cls(tokens, merges)

    def spine(self, token: int) -> tuple | None:
        """How the token grows from its bytes: for its left edge and for its right edge, the rows (symbol, time it
        appears, time it is merged away); None if merging its bytes does not give the token."""
        if token not in self.spines:
            self.spines[token] = self._grow(token)
        return self.spines[token]

    def _grow(self, token: int) -> tuple | None:
        symbols = [self.tokens[bytes([b])] for b in self.bytes_of[token]]
        left, right, clock = [[symbols[0], -1]], [[symbols[-1], -1]], -1
        while len(symbols) > 1:
            found = [(m[0], k, m[1]) for k in range(len(symbols) - 1) if (m := self.merges.get((symbols[k], symbols[k + 1])))]
            if not found:
                return None
            order, k, whole = min(found)
            clock = max(clock, order)
            symbols[k : k + 2] = [whole]
            if k == 0:
                left[-1].append(clock)
                left.append([whole, clock])
            if k == len(symbols) - 1:
                right[-1].append(clock)
                right.append([whole, clock])
        if symbols != [token]:
            return None
        never = float("inf")
        return tuple(tuple((*row, never)[:3] for row in side) for side in (left, right))

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a, b: no merge across the border comes before both ends are final."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        merges, edge = self.merges, self.spine(b)[0]
        for x, x_from, x_to in self.spine(a)[1]:
            for y, y_from, y_to in edge:
                if (x, y) in merges and x_from <= y_to and y_from <= x_to:
                    at = max(merges[x, y][0], x_from, y_from)
                    if at < x_to and at <= y_to:
                        return False
        return True


class Endings:
    """Which tokens end here, and which may still be under way: an automaton over the longest suffix of the bytes so far
    that begins a token, with its arcs made when first taken."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.begins = {b[:i] for b in vocabulary.tokens for i in range(1, len(b) + 1)}
        self.longer = {b[:i] for b in vocabulary.tokens for i in range(1, len(b))}
        self.ids: dict[bytes, int] = {b"": 0}
        self.held: list[bytes] = [b""]
        self.tokens: list[tuple[tuple[int, int], ...]] = [()]
        self.open: list[tuple[int, ...]] = [(0,)]
        self.arcs: dict[int, int] = {}

    def step(self, state: int, b: int) -> int:
        held = self.held[state] + bytes([b])
        while held not in self.begins:
            held = held[1:]
        if held not in self.ids:
            v = self.vocabulary
            ends = [held[k:] for k in range(len(held))]
            self.ids[held] = len(self.held)
            self.held.append(held)
            self.tokens.append(tuple((v.tokens[e], len(e)) for e in ends if e in v.tokens and v.spine(v.tokens[e]) is not None))
            self.open.append((*(len(e) for e in ends if e in self.longer), 0))
        to = self.arcs[state << 8 | b] = self.ids[held]
        return to


class PrefixCounts:
    """Exact token counts of every byte prefix of a piece, by dynamic programming over a trie of the prefixes seen."""

    def __init__(self, vocabulary: Vocabulary, cap: int = 600_000):
        self.vocabulary, self.endings, self.cap = vocabulary, Endings(vocabulary), cap
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.count, self.at = [-1], [0], [0]

    #: Bytes of the pieces that the trie holds, at most; longer ones are counted in a table of their own.
    LONGEST = 1024

    def _long(self, piece: bytes) -> Iterator[int]:
        """Tokens of piece[:1], piece[:2], ..., piece, holding only as many of them as the longest token has bytes."""
        endings, pairs, follows = self.endings, self.vocabulary.pairs, self.vocabulary.follows
        keep = max(map(len, self.vocabulary.tokens))
        last, count, at, first = [-1], [0], 0, 0  # of the prefixes from `first` bytes on
        for end, b in enumerate(piece, 1):
            to = endings.arcs.get(at << 8 | b)
            at = endings.step(at, b) if to is None else to
            for token, size in endings.tokens[at]:
                if end == size:
                    break
                left = last[end - size - first]
                fits = pairs.get((left, token))
                if follows(left, token) if fits is None else fits:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            count.append(count[end - size - first] + 1)
            if len(last) > 2 * keep:
                first += len(last) - keep
                del last[:-keep], count[:-keep]
            yield count[-1]

    def _walk(self, piece: bytes) -> list[int]:
        """The trie's nodes of b"", piece[:1], ..., piece."""
        if len(self.last) > self.cap:
            self._clear()
        child, node, path = self.child, 0, [0]
        for b in piece:
            step = child.get(node << 8 | b)
            if step is None:
                step = self._grow(node, b, path)
            node = step
            path.append(node)
        return path

    def _grow(self, node: int, b: int, path: list[int]) -> int:
        endings, last, pairs, end = self.endings, self.last, self.vocabulary.pairs, len(path)
        at = endings.arcs.get(self.at[node] << 8 | b)
        if at is None:
            at = endings.step(self.at[node], b)
        for token, size in endings.tokens[at]:
            before = path[end - size]
            if before == 0:
                break
            fits = pairs.get((last[before], token))
            if self.vocabulary.follows(last[before], token) if fits is None else fits:
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        step = self.child[node << 8 | b] = len(last)
        last.append(token)
        self.count.append(self.count[before] + 1)
        self.at.append(at)
        return step

    def table(self, piece: bytes) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..., piece."""
        if len(piece) > self.LONGEST:
            return list(self._long(piece))
        return [self.count[n] for n in self._walk(piece)[1:]]

    def total(self, piece: bytes) -> int:
        if len(piece) > self.LONGEST:
            return deque(self._long(piece), 1)[0]
        node = self._walk(piece)[-1]
        return self.count[node]


class Arcs:
    """Numbers by keys from 0 on, looked up and put in many at a time: arrays with open addressing."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place that it would take."""
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            at[left] = after = at[left] + 1 & (1 << self.bits) - 1
            there = self.keys[after]
            left = left[(there != keys[left]) & (there >= 0)]
        return at

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct ones that are not there yet."""
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(int(4 * self.size).bit_length())
            self.size = len(keys)
        while len(keys):
            at = self.find(keys)
            self.keys[at] = keys  # of keys that want the same place one gets it
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values = keys[~got], values[~got]


class Transducer:
    """Bytes in, token ids out. A state is the last token given out and the bytes since; a token is given out as soon as
    every reading of the bytes to come agrees on it, so at most the longest token's length is held back. States whose
    last tokens bar the same tokens from following are one state."""

    def __init__(self, vocabulary: Vocabulary, cap: int = 400_000):
        self.vocabulary, self.endings, self.cap = vocabulary, Endings(vocabulary), cap
        self.sorted = sorted(vocabulary.tokens)
        self.longer: dict[bytes, tuple[int, ...] | None] = {}  # by beginnings of tokens, so no more than the vocabulary has
        self.given: dict[bytes, int] = {b"": 0}
        self._clear()

    def _barred(self, anchor: int, held: bytes) -> int | tuple[int, ...]:
        """Which longer tokens that begin with `held` may not follow anchor; anchor itself where there are many such."""
        longer = self.longer.get(held, self)
        if longer is self:
            longer = self.longer[held] = self._longer(held)
        if longer is None:
            return anchor
        if anchor < 0 or not longer:
            return ()
        follows, pairs = self.vocabulary.follows, self.vocabulary.pairs
        return tuple([t for t in longer if not (follows(anchor, t) if (fits := pairs.get((anchor, t))) is None else fits)])

    def _longer(self, held: bytes) -> tuple[int, ...] | None:
        """The longer tokens that begin with `held` and that merges reach; None where there are many."""
        if not held or held[-1] == 255:
            return None
        first, end = bisect_right(self.sorted, held), bisect_left(self.sorted, held[:-1] + bytes([held[-1] + 1]))
        if end - first > self.MOST_LONGER:
            return None
        v = self.vocabulary
        return tuple(t for t in (v.tokens[b] for b in self.sorted[first:end]) if v.spine(t) is not None)

    #: Longer tokens that are compared to tell states apart, at most.
    MOST_LONGER = 48

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {(b"", (), -1): 0}
        #: Anchor, bytes held, their last tokens by end, the ends of the tokens before each end as bits, state in endings.
        self.states: list[tuple] = [(-1, b"", (), (1,), 0)]
        #: Parts of states, each kept once.
        self.same: dict = {}
        self.arcs: dict[int, tuple[int, bytes]] = {}
        self.ends: dict[int, bytes] = {}
        #: For many pieces side by side: arcs as next state << 32 | number in `given`, and what the ends give by state, -1 if not known.
        self.table, self.closing = Arcs(), np.full(1024, -1, np.int32)

    @staticmethod
    def _write(last: tuple[int, ...], ends: int) -> bytes:
        """The tokens that end where bits are set, but for bit 0."""
        out = []
        while ends > 1:
            end = ends.bit_length() - 1
            out.append(last[end - 1])
            ends ^= 1 << end
        return struct.pack(f"<{len(out)}i", *out[::-1])

    def _step(self, state: int, b: int) -> tuple[int, bytes]:
        anchor, held, last, ends, at = self.states[state]
        endings, pairs = self.endings, self.vocabulary.pairs
        to = endings.arcs.get(at << 8 | b)
        if to is None:
            to = endings.step(at, b)
        size = len(held) + 1
        for token, width in endings.tokens[to]:
            start = size - width
            if start < 0:
                continue
            before = last[start - 1] if start else anchor
            if before < 0:
                break
            fits = pairs.get((before, token))
            if self.vocabulary.follows(before, token) if fits is None else fits:
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last, ends, shared = (*last, token), (*ends, ends[start] | 1 << size), -1
        for width in endings.open[to]:
            if width <= size:
                shared &= ends[size - width]
        sure, out, held = shared.bit_length() - 1, b"", held + bytes([b])
        if sure:
            out = self._write(last, shared)
            anchor, held, last, ends = last[sure - 1], held[sure:], last[sure:], tuple(e >> sure for e in ends[sure:])
        key = (held, last, self._barred(anchor, held))
        known = self.ids.get(key)
        if known is None:
            known, same = len(self.states), self.same.setdefault
            held, last, ends, barred = same(held, held), same(last, last), same(ends, ends), same(key[2], key[2])
            self.ids[held, last, barred] = known
            self.states.append((anchor, held, last, ends, to))
        return known, out

    def _end(self, state: int) -> bytes:
        """What is given out where a piece ends."""
        _, _, last, ends, _ = self.states[state]
        return self._write(last, ends[-1])

    def encode(self, piece: bytes) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(self.states) > self.cap:
            self._clear()
        arcs, state, out = self.arcs, 0, b""
        for b in piece:
            arc = arcs.get(state << 8 | b)
            if arc is None:
                if len(self.states) > self.cap:  # also within a long piece; its state alone stays
                    own = self.states[state]
                    self._clear()
                    self.states.append(own)
                    arcs, state = self.arcs, 1
                arc = arcs[state << 8 | b] = self._step(state, b)
            state, more = arc
            if more:
                out += more
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._end(state)
        return out + end

    #: Pieces that go side by side, at most.
    LANES = 1 << 15

    def encode_many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        """The ids of the pieces data[start : start + size], by the same automaton: all take a byte at a time, side by side."""
        if len(self.states) > self.cap or len(self.given) > self.cap:
            self.given = {b"": 0}
            self._clear()
        order = np.argsort(-sizes, kind="stable")
        codes, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), self.LANES):
            lanes = order[at : at + self.LANES]
            steps = self._side_by_side(data, starts[lanes], sizes[lanes]).T
            codes.append(steps[steps > 0])
            counts.append(np.count_nonzero(steps, axis=1))
        tokens = joined_lists(list(self.given), 4, pa.int32())
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return joined(joined(tokens, np.concatenate(codes), np.concatenate(counts)), places)

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What is given out after each byte and at the end, as numbers in `given`; the longest piece comes first."""
        longest = int(sizes[0])
        out, state = np.zeros((longest + 1, len(sizes)), np.int32), np.zeros(len(sizes), np.int64)
        under_way = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
        for i, n in enumerate(under_way.tolist()):
            if len(self.states) > self.cap:  # the states that pieces are in stay
                now, state = np.unique(state, return_inverse=True)
                own = [self.states[s] for s in now.tolist()]
                self._clear()
                state += len(self.states)
                self.states += own
            key = state[:n] << 8 | data[starts[:n] + i]
            at = self.table.find(key)
            new = key[self.table.keys[at] != key]
            if new.size:
                self._learn(np.unique(new))
                at = self.table.find(key)
            to = self.table.values[at]
            state[:n], out[i, :n] = to >> 32, to & 0xFFFFFFFF
        if len(self.closing) < len(self.states):
            self.closing = np.concatenate([self.closing, np.full(len(self.states), -1, np.int32)])
        for s in np.unique(state[self.closing[state] < 0]).tolist():
            self.closing[s] = self.given.setdefault(self._end(s), len(self.given))
        out[longest] = self.closing[state]
        return out

    def _learn(self, keys: np.ndarray) -> None:
        arcs = [self._step(k >> 8, k & 255) for k in keys.tolist()]
        self.table.put(keys, np.array([to << 32 | self.given.setdefault(more, len(self.given)) for to, more in arcs], np.int64))


def joined(parts: pa.ListArray, which: np.ndarray, counts: np.ndarray | None = None) -> pa.ListArray:
    """The lists parts[which]; with counts, the first counts[0] of them as one list, and so on."""
    taken = parts.take(pa.array(which))
    if counts is None:
        return taken
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[ends]), taken.flatten())


class Pieces:
    """Splits text by PATTERN and looks whole space-separated chunks up in a bounded memo.

    A chunk starts at a space. Splitting there changes no piece unless white space stands next to the space; `each` then
    goes over the pieces one by one.
    """

    def __init__(self, of_piece, join, cap: int = 400_000):
        import re

        import regex

        self.split_any, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.separators = re.compile("[\x1c-\x1f]").search
        self.join, self.piece = join, Memo(lambda p: of_piece(p.encode("utf-8", "replace")), cap // 16)
        self.chunk = Memo(self._chunk, cap)

    def pieces(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() and not self.separators(text) else self.split_any(text)

    def _chunk(self, chunk: str):
        """None where white space stands next to the space before or after the chunk."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self.join(map(self.piece.__getitem__, self.pieces(" " + chunk)))

    def each(self, text: str):
        """join() of what of_piece gives for each piece of the text."""
        first, *rest = text.split(" ")
        rest = list(map(self.chunk.__getitem__, rest))
        if None in rest:
            return self.join(map(self.piece.__getitem__, self.pieces(text)))
        return self.join((self.join(map(self.piece.__getitem__, self.pieces(first))), self.join(rest)))
