"""Binned bitmaps: for each bin the positions of its values, plain and run-length compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..column import Column
from ..functions.binning import Bins
from .scan import Range

#: Bits of a code word's payload; longest fill.
PAYLOAD = 31
MOST_FILL = (1 << 30) - 1
#: Positions whose bits of one bin are encoded by one task at a time.
STRETCH = PAYLOAD << 15


def bitmap_groups(column: Column, bins: Bins) -> DataFrame:
    """(bin, grp, bits, n): of each bin and each 31 positions in a row the positions set, lowest first; groups without any
    are left out. One partial aggregation."""
    one = F.call_function("shiftleft", F.lit(1), F.expr(f"cast(pos % {PAYLOAD} as int)"))
    return column.rows.select(bins.bin_of(F.col("v")).alias("bin"), F.expr(f"pos div {PAYLOAD}").alias("grp"), one.alias("b")).where("bin is not null").groupBy("bin", "grp").agg(F.bit_or("b").alias("bits"), F.count(F.lit(1)).alias("n"))


def encode_positions(positions: np.ndarray, start: int, end: int) -> list[int]:
    """Code words of the bits start..end-1, of which those at the (sorted) positions are set.

    A word with its top bit set holds the next 31 bits, the first in its lowest bit. Another is a fill: bit 30 is the
    bits' value, the rest their number. A run of over 31 - 1 equal bits, counted from where the last word ended, is a
    fill; else a literal follows.
    """
    words, at, k = [], start, 0
    ends = np.flatnonzero(np.diff(positions) != 1)  # of runs of set bits
    while at < end:
        if k < len(positions) and positions[k] == at:
            value, stop = 1, int(positions[ends[j]] if (j := np.searchsorted(ends, k)) < len(ends) else positions[-1]) + 1
        else:
            value, stop = 0, int(positions[k]) if k < len(positions) else end
        run = min(stop - at, MOST_FILL)
        if run > PAYLOAD - 1:
            words.append(value << 30 | run)
            at += run
        else:
            stop = min(at + PAYLOAD, end)
            word = 1 << 31
            while k < len(positions) and positions[k] < stop:
                word |= 1 << int(positions[k]) - at
                k += 1
            words.append(word)
            at = stop
            continue
        if value:
            k += run
    return words


def decode_words(words: list[int], start: int, end: int) -> Iterator[int]:
    """The positions that are set."""
    at = start
    for word in words:
        if word >> 31:
            yield from (at + k for k in range(min(PAYLOAD, end - at)) if word >> k & 1)
            at += min(PAYLOAD, end - at)
        else:
            if word >> 30:
                yield from range(at, at + (word & MOST_FILL))
            at += word & MOST_FILL


def wah_encode(column: Column, bins: Bins, stretch: int = STRETCH) -> DataFrame:
    """(bin, start, word_no, word): the code words of each bin's bits, by stretches of positions that start at `start`.

    Encoding is sequential; with stretches no task sees more than `stretch` positions of a bin, and a stretch as long as
    the column gives one sequence a bin. Bins without values have no words.
    """
    n = column.n
    groups = bitmap_groups(column, bins).withColumn("start", F.expr(f"grp * {PAYLOAD} div {stretch} * {stretch}"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        start = int(pdf["start"].iloc[0])
        set_bits = (pdf["bits"].to_numpy(np.int64)[:, None] >> np.arange(PAYLOAD)) & 1
        positions = (pdf["grp"].to_numpy()[:, None] * PAYLOAD + np.arange(PAYLOAD))[set_bits == 1]
        words = encode_positions(positions, start, min(start + stretch, n))
        return pd.DataFrame({"bin": pdf["bin"].iloc[0], "start": start, "word_no": range(len(words)), "word": words})

    return groups.groupBy("bin", "start").applyInPandas(encode, "bin int, start bigint, word_no int, word bigint")


def wah_positions(words: DataFrame) -> DataFrame:
    """(bin, pos) of the code words, by running sums and built-in functions; `end` of the column cuts nothing, as the
    padding of a last literal is never set."""
    literal = F.col("word") >= 2**31
    many = F.when(literal, PAYLOAD).otherwise(F.col("word").bitwiseAND(F.lit(MOST_FILL)))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("bin", "start").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = words.withColumn("many", many).withColumn("at", F.col("start") + before)
    bits = F.filter(F.sequence(F.lit(0), F.lit(PAYLOAD - 1)), lambda k: F.call_function("shiftright", F.col("word"), k).bitwiseAND(F.lit(1)) == 1)
    offsets = F.when(literal, F.transform(bits, lambda k: k.cast("bigint"))).when(F.col("word").bitwiseAND(F.lit(1 << 30)) != 0, F.sequence(F.lit(0).cast("bigint"), F.col("many").cast("bigint") - 1))
    return placed.select("bin", "at", F.explode(offsets).alias("k")).select("bin", (F.col("at") + F.col("k")).alias("pos"))


def bitmap_positions(column: Column, bins: Bins, words: DataFrame, wanted: Range) -> DataFrame:
    """Positions of qualifying rows: those of bins strictly inside the range need no check, those of its end bins are
    checked against the values. The bins are disjoint, so a union merges them; only the result is sorted."""
    low, high = bins.find(wanted.low), bins.find(wanted.high)
    hits = wah_positions(words.where(F.col("bin").between(low, high)))
    inner = hits.where((F.col("bin") > low) & (F.col("bin") < high)).select("pos")
    edge = column.rows.where(wanted.holds(F.col("v"))).join(hits.where(F.col("bin").isin(low, high)).select("pos"), "pos", "left_semi").select("pos")
    return inner.union(edge).orderBy("pos")


def bitmap_count(column: Column, bins: Bins, words: DataFrame, wanted: Range) -> DataFrame:
    return bitmap_positions(column, bins, words, wanted).agg(F.count(F.lit(1)).alias("n"))


