"""Exact token counts of whole texts and of each of their prefixes (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces, PrefixCounts, Vocabulary
from .common import kept, slices, texts_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The string that this vocabulary's library reads as one token wherever it stands in a text; a fixed value of the file.
SPECIAL = "<|endoftext|>"


class TokenCounter:
    """Counts tokens by dynamic programming over prefixes; each number is what encoding that prefix alone would give.
    special: the vocabulary's special string, read as one token; none where it is empty."""

    def __init__(self, path: str = VOCABULARY, special: str = SPECIAL):
        self.special, self.counts = special, PrefixCounts(Vocabulary.from_json(path))
        self.pieces = Pieces(self.counts.total, sum)

    def count(self, text: str) -> int:
        if self.special not in text:
            return self.pieces.each(text)
        parts = text.split(self.special)
        return sum(self.pieces.each(p) for p in parts if p) + len(parts) - 1

    def _ordinary(self, text: str) -> list[int]:
        """prefixes() of a text in which the special string is no special string."""
        out, before, gap = [], 0, ""
        for piece in self.pieces.pieces(text):
            table = self.counts.table(piece.encode("utf-8", "replace"))
            sizes = np.cumsum([len(c.encode("utf-8", "replace")) for c in piece])
            inside = [before + table[n - 1] for n in sizes]
            if piece in ("'re", "'ve", "'ll"):  # cut short, the mark and the letter are pieces of their own
                inside[1] = before + 2
            if gap and piece[0].isspace():  # cut here, the space belongs to the white space before it
                inside[0] = before - self.counts.total(gap.encode()) + self.counts.total((gap + piece[0]).encode())
            out += inside
            before, gap = before + table[-1], piece if piece.isspace() else ""
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        out, before = [0], 0
        parts = text.split(self.special)
        for k, part in enumerate(parts):
            if k + 1 < len(parts):
                inside = self._ordinary(part + self.special)
                out += [before + n for n in inside[:-1]]
                before += (inside[len(part) - 1] if part else 0) + 1
                out.append(before)
            else:
                out += [before + n for n in self._ordinary(part)]
        return np.array(out, np.int32)


def longest_within(prefix_tokens: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens, from the counts that prefixes() gave; nothing is encoded
    again. A longer prefix may have fewer tokens, so the last that fits counts."""
    return int(np.flatnonzero(prefix_tokens <= budget).max(initial=0))


@kept
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str = VOCABULARY, budget: int | None = None, with_prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text; docs: doc_id and text, other columns are left out.

    with_prefixes adds prefix_tokens, the tokens of the text's first 0, 1, 2, ... characters; budget adds cut_chars, the
    length of the longest prefix of that many tokens at most. A null text counts as an empty one: 0 bytes, 0 tokens. Rows
    with equal or null ids each give a row; an empty table gives none. Rows never leave their partition.
    """
    extra = ", cut_chars long" * (budget is not None) + ", prefix_tokens array<int>" * with_prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in slices(batches, 2048 if not extra else 64):
            texts = texts_of(batch)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(s.encode("utf-8", "replace")) for s in texts], pa.int64()),
                "n_tokens": pa.array([tokens.count(s) for s in texts], pa.int64()),
            }
            stored = [tokens.prefixes(s) for s in texts] if extra else []
            if budget is not None:
                columns["cut_chars"] = pa.array([longest_within(p, budget) for p in stored], pa.int64())
            if with_prefixes:
                columns["prefix_tokens"] = pa.array(stored, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long" + extra)


