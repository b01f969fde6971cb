"""Samples, bounds and bins.

bin(v) is the number of bounds, but for the last, that v exceeds. It never falls as v grows, which is all that the access
paths rely on, whatever the bounds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column
from ..types import ColumnType

SAMPLE = 2048
#: Numbers of bins that a signature may have; fixed values.
SIZES = (8, 16, 32, 64, 128, 256)


def sample(column: Column, size: int = SAMPLE) -> DataFrame:
    """(pos, v) at the positions floor(i * n / size), i = 0..size-1, without null values; a plain filter, no join."""
    n = max(column.n, 1)
    i = f"((pos * {size} + {n} - 1) div {n})"
    return column.rows.where(f"{i} < {size} and ({i} * {n}) div {size} = pos and v is not null")


def distinct_sample(column: Column, size: int = SAMPLE) -> list:
    """The distinct sampled values in order; at most `size` of them come to the driver."""
    return sorted(r.v for r in sample(column, size).select("v").distinct().collect())


def bins_for(n_distinct: int, most: int) -> int:
    """Bins for so many distinct sampled values: the smallest size above it, or `most` where that would not do."""
    return next(b for b in SIZES if b > max(n_distinct, 1)) if n_distinct < most - 1 else most


def bounds_of(values: Sequence, most: int, kind: ColumnType) -> list:
    """Bounds from a sorted distinct sample: one bin a value where they are few, else equal shares of the distinct values.

    The last bound is the type's largest value and is never compared.
    """
    if most not in SIZES:
        raise ValueError(f"{most} bins; allowed are {SIZES}")
    n = len(values)
    bins = bins_for(n, most)
    if n < most - 1:
        return [*values, *[kind.most] * (bins - n)]
    middle = [values[k * n // (most - 2)] for k in range(1, most - 2)]
    return [values[1], *middle, values[-1], kind.most]


def equi_depth_bounds(frequencies: Sequence[tuple], bins: int, kind: ColumnType) -> list:
    """Bounds that close a bin once it holds its share of all sampled rows; frequencies: (value, rows) in order.

    A bin takes values until its rows reach total / min(values, bins - 2); bins that stay empty get the type's largest.
    """
    total, share = sum(n for _, n in frequencies), max(1, min(len(frequencies), bins - 2))
    bounds, held = [], 0
    for value, n in frequencies:
        held += n
        if held * share >= total and len(bounds) < bins - 2:
            bounds.append(value)
            held = 0
    return [*bounds, *[kind.most] * (bins - len(bounds))]


@dataclass(frozen=True)
class Bins:
    """Bounds of a column's bins; the same object gives bins of rows (bin_of) and of query limits (find)."""

    bounds: tuple
    type: ColumnType

    def __len__(self) -> int:
        return len(self.bounds)

    @property
    def compared(self) -> list:
        """The bounds that are compared, in order."""
        return sorted(self.bounds[:-1])

    def find(self, value) -> int:
        return bisect_left(self.compared, value)

    def bin_of(self, v: SparkColumn) -> SparkColumn:
        """A balanced tree of comparisons, which stays in generated code; null for null."""
        bounds = self.compared

        def tree(low: int, high: int) -> SparkColumn:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(v > F.lit(bounds[middle]).cast(self.type.spark), tree(middle + 1, high)).otherwise(tree(low, middle))

        return F.when(v.isNotNull(), tree(0, len(bounds)))

    def bin_by_count(self, v: SparkColumn) -> SparkColumn:
        """The same by its definition, over an array of the bounds."""
        limits = F.array(*(F.lit(b).cast(self.type.spark) for b in self.bounds[:-1]))
        return F.when(v.isNotNull(), F.size(F.filter(limits, lambda b: v > b)))


def bins_of(column: Column, most: int = 64) -> Bins:
    """Bins from the column's sample."""
    return Bins(tuple(bounds_of(distinct_sample(column), most, column.type)), column.type)


def equi_depth_bins(column: Column, bins: int = 64) -> Bins:
    counts = sample(column).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    return Bins(tuple(equi_depth_bounds(sorted((r.v, r.n) for r in counts), bins, column.type)), column.type)


def make_bins(column: Column, most: int = 64, histogram: str = "equidistinct") -> Bins:
    """Bins by the named histogram: equal shares of the distinct sampled values, or of the sampled rows."""
    if histogram not in ("equidistinct", "equidepth"):
        raise ValueError(f"histogram {histogram}")
    return bins_of(column, most) if histogram == "equidistinct" else equi_depth_bins(column, most)
