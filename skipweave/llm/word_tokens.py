"""Ids of the lower-casing word vocabulary, as its library gives them, with repeated words looked up in a bounded memo."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

from .bpe import byte_alphabet
from .common import Memo, kept

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The id that ends a document in a packed sequence.
END = 2
#: Characters that are their own NFC form, are lowered one by one and are no number but 0 to 9.
PLAIN = "!-~\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f"
#: The letters among them, once lowered.
LETTERS = "".join(sorted({c.lower() for c in map(chr, range(0x250)) if re.match(f"[{PLAIN}]", c) and c.isalpha()}))


class WordTokens:
    """The vocabulary drops white space and never joins across it, so each chunk between spaces can be encoded alone."""

    plain = staticmethod(re.compile(f"[ \\n{PLAIN}]*").fullmatch)
    #: The vocabulary's own split, for plain text: letters, a digit, an ending or other characters, and no white space.
    split = staticmethod(re.compile(rf"[{LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \n0-9{LETTERS}]+").findall)
    #: Characters that are split at a time, more only where no space ends them.
    PART = 1 << 16
    shown = {b: c for c, b in byte_alphabet().items()}

    def __init__(self, path: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.piece, self.chunk = Memo(self._piece, 300_000), Memo(self._chunk, 30_000)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.split(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if self.plain(chunk) and "<|" not in chunk:
            return self._plain(chunk)
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """The text, cut at spaces."""
        at = 0
        while len(text) - at > self.PART:
            cut = text.rfind(" ", at + 1, at + self.PART)
            if cut < 0 and (cut := text.find(" ", at + self.PART)) < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encode(self, text: str, end: int | None = END) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, then `end`."""
        ids = []
        for part in self._parts(text):
            if self.plain(part) and "<|" not in part:
                ids.append(self._plain(part))
            else:  # each chunk on its own, as most are plain
                ids += map(self.chunk.__getitem__, part.replace("\n", " ").split(" "))
        if end is not None:
            ids.append(int(end).to_bytes(4, "little"))
        return b"".join(ids)


@kept
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def worker_word_tokens(path: str) -> WordTokens:
    """word_tokens(), for functions sent to workers: Spark's pickles copy what kept() returns, with an empty memory of its
    own for each task, but only name this function, so that the tasks of a worker share their words."""
    return word_tokens(path)
