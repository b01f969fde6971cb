"""Range and point predicates, and the plain scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column


@dataclass(frozen=True)
class Range:
    """low < v <= high, or with other ends: "(]", "[)", "[]", "()"."""

    low: object
    high: object
    ends: str = "(]"

    def __post_init__(self):
        if self.ends not in ("(]", "[)", "[]", "()"):
            raise ValueError(f"ends {self.ends}")

    def holds(self, v: SparkColumn) -> SparkColumn:
        low, high = F.lit(self.low), F.lit(self.high)
        return (v > low if self.ends[0] == "(" else v >= low) & (v <= high if self.ends[1] == "]" else v < high)

    def covers(self, least: SparkColumn, most: SparkColumn) -> SparkColumn:
        """Whether all values between least and most qualify."""
        low, high = F.lit(self.low), F.lit(self.high)
        return (low < least if self.ends[0] == "(" else low <= least) & (high >= most if self.ends[1] == "]" else high > most)

    def misses(self, least: SparkColumn, most: SparkColumn) -> SparkColumn:
        """Whether no value between least and most can qualify."""
        low, high = F.lit(self.low), F.lit(self.high)
        return (high < least if self.ends[1] == "]" else high <= least) | (low >= most if self.ends[0] == "(" else low > most)


def point(value) -> Range:
    return Range(value, value, "[]")


def qualifying(column: Column, wanted: Range) -> DataFrame:
    """(pos, v) of the rows that qualify; null and NaN never do. The predicate reaches the Parquet scan."""
    return column.between(wanted.low, wanted.high).where(wanted.holds(F.col("v")))


def scan_count(column: Column, wanted: Range) -> DataFrame:
    return qualifying(column, wanted).agg(F.count(F.lit(1)).alias("n"))


def scan_positions(column: Column, wanted: Range) -> DataFrame:
    """Positions in order; only the result is sorted."""
    return qualifying(column, wanted).select("pos").orderBy("pos")


def scan_sum(column: Column, wanted: Range) -> DataFrame:
    """Sum of the qualifying values (null where none qualifies)."""
    return qualifying(column, wanted).agg(F.sum("v").alias("total"))
