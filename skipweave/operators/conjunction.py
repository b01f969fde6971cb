"""Conjunctions over several columns of one table, by their candidate blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import raw_limits, value_of
from .scan import Range, qualifying
from .signature import Signatures
from .zonemap import FULL, PARTIAL


def conjunction_positions(terms: list[tuple[Signatures, Range]]) -> DataFrame:
    """Positions that satisfy all terms, for columns that are stored apart: each is read in the units that are candidates of
    all columns. Columns of one table are better read by qualifying_tuples()."""
    unit, common = candidate_units(terms)
    hits = [qualifying(index.column, wanted).withColumn("unit", F.expr(f"pos div {unit}")).join(common, "unit", "left_semi").select("pos") for index, wanted in terms]
    return reduce(lambda a, b: a.join(b, "pos", "left_semi"), hits).orderBy("pos")


def candidate_units(terms: list[tuple[Signatures, Range]]) -> tuple[int, DataFrame]:
    """(rows of a unit, (unit) that are candidates of all terms).

    Candidate blocks of columns of other widths span other numbers of rows, so each is split into units of the smallest
    block. Block sizes must be multiples of the smallest.
    """
    unit = min(index.values_per_block for index, _ in terms)
    if any(index.values_per_block % unit for index, _ in terms):
        raise ValueError("block sizes are no multiples of the smallest")

    def units(index: Signatures, wanted: Range) -> DataFrame:
        many = index.values_per_block // unit
        blocks = index.classify(wanted).where(F.col("verdict").isin(FULL, PARTIAL)).select("block_id")
        return blocks.select(F.explode(F.sequence(F.col("block_id") * many, F.col("block_id") * many + many - 1)).alias("unit"))

    return unit, reduce(lambda a, b: a.join(b, "unit", "left_semi"), (units(*t) for t in terms))


def qualifying_tuples(df: DataFrame, pos: str, terms: dict[str, tuple[Signatures, Range]]) -> DataFrame:
    """pos and the values of the named columns of df where all terms hold: one scan of df, with all ranges pushed to it, of
    the rows in units that are candidates of all columns."""
    unit, common = candidate_units(list(terms.values()))
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), *(F.col(c).alias(f"raw_{k}") for k, c in enumerate(terms)))
    for k, (name, (_, wanted)) in enumerate(terms.items()):
        field = df.schema[name].dataType
        low, high = raw_limits(field, wanted.low, wanted.high)
        rows = rows if low is None else rows.where(F.col(f"raw_{k}") >= low)
        rows = rows if high is None else rows.where(F.col(f"raw_{k}") <= high)
        rows = rows.where(wanted.holds(value_of(F.col(f"raw_{k}"), field)))
    values = [value_of(F.col(f"raw_{k}"), df.schema[c].dataType).alias(c) for k, c in enumerate(terms)]
    return rows.withColumn("unit", F.expr(f"pos div {unit}")).join(common, "unit", "left_semi").select("pos", *values)


def tuples(positions: DataFrame, columns: dict) -> DataFrame:
    """Rows put together again at the positions: pos and a value of each named column."""
    out = positions
    for name, column in columns.items():
        out = out.join(column.rows.select("pos", F.col("v").alias(name)), "pos")
    return out
