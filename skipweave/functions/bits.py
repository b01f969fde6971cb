"""Bit vectors of up to 256 bins as 64-bit words w0, w1, ...; bit k of word k div 64 is bin k."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_words(bins: int) -> int:
    return (bins + 63) // 64


def word_names(bins: int) -> list[str]:
    return [f"w{k}" for k in range(n_words(bins))]


def signed(word: int) -> int:
    """A 64-bit pattern as Spark's signed number."""
    return word - (1 << 64) if word >> 63 else word


def words_of(bits: int, bins: int) -> list[int]:
    return [signed(bits >> 64 * k & (1 << 64) - 1) for k in range(n_words(bins))]


def bit(bin_no: Column, word: int) -> Column:
    """The word with bit bin_no set, or 0 where that bit is in another word; null for a null bin."""
    inside = F.call_function("shiftleft", F.lit(1).cast("bigint"), bin_no % 64)
    return F.when(bin_no.isNotNull(), F.when(F.call_function("shiftright", bin_no, F.lit(6)) == word, inside).otherwise(F.lit(0).cast("bigint")))


def any_common(names: Sequence[str], words: Sequence[int]) -> Column:
    """Whether the vector shares a bit with the given words."""
    out = F.lit(False)
    for name, word in zip(names, words):
        if word:
            out = out | (F.col(name).bitwiseAND(F.lit(word)) != 0)
    return out


def all_within(names: Sequence[str], words: Sequence[int]) -> Column:
    """Whether all bits of the vector are among those of the given words."""
    out = F.lit(True)
    for name, word in zip(names, words):
        out = out & (F.col(name).bitwiseAND(F.lit(~word)) == 0)
    return out


def popcount(columns: Iterable[Column]) -> Column:
    return sum((F.bit_count(c) for c in columns), F.lit(0))


def as_text(columns: Sequence[Column], bins: int) -> Column:
    """Bins from the first on as "x" (set) or "."."""
    parts = [F.translate(F.reverse(F.lpad(F.bin(c), 64, "0")), "01", ".x") for c in columns]
    return F.substring(F.concat(*parts), 1, bins)


def as_text_high_first(columns: Sequence[Column], bins: int) -> Column:
    """The same from the last bin on."""
    return F.reverse(as_text(columns, bins))


def first_bit(columns: Sequence[Column]) -> Column:
    """Lowest bin that is set; null if none is."""
    low = lambda c: F.bit_count(c.bitwiseAND(-c) - 1)  # noqa: E731  the bits below the lowest that is set
    return F.coalesce(*(F.when(c != 0, low(c) + 64 * k) for k, c in enumerate(columns)))


def last_bit(columns: Sequence[Column]) -> Column:
    """Highest bin that is set; null if none is."""
    high = lambda c: F.length(F.bin(c)) - 1
    return F.coalesce(*(F.when(c != 0, high(c) + 64 * k) for k, c in reversed(list(enumerate(columns)))))


def bins_set(columns: Sequence[Column], bins: int) -> Column:
    """An array of the bins that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: _is_set(columns, b))


def _is_set(columns: Sequence[Column], b: Column) -> Column:
    out = F.lit(False)
    for k, c in enumerate(columns):
        out = out | ((F.call_function("shiftright", b, F.lit(6)) == k) & (F.call_function("shiftright", c, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1))
    return out
