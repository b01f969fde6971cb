"""Choice of an access path by estimated selectivity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import Range, qualifying
from ..operators.signature import Signatures
from ..operators.zonemap import SKIP

#: Share of rows in candidate blocks from which a plain scan is chosen; most position ranges that are pushed to a scan.
SCAN_FROM = 0.5
MOST_RANGES = 256
#: Blocks that one task of candidate_ranges orders.
SEGMENT = 1 << 22


def candidate_share(index: Signatures, wanted: Range) -> float:
    """Share of the column's rows that lie in blocks which are not skipped; from the index alone."""
    row = index.classify(wanted).agg(F.sum(F.when(F.col("verdict") != SKIP, F.col("n_rows"))).alias("read"), F.sum("n_rows").alias("all")).first()
    return (row["read"] or 0) / row["all"] if row["all"] else 0.0


def candidate_ranges(index: Signatures, wanted: Range) -> DataFrame:
    """(pos_lo, pos_hi): runs of neighbouring candidate blocks as position ranges; runs end at the ends of segments."""
    blocks = index.classify(wanted).where(F.col("verdict") != SKIP).select("block_id", F.expr(f"block_id div {SEGMENT}").alias("segment"))
    island = F.col("block_id") - F.row_number().over(Window.partitionBy("segment").orderBy("block_id"))
    runs = blocks.withColumn("island", island).groupBy("segment", "island").agg(F.min("block_id").alias("first"), F.max("block_id").alias("last"))
    per = index.values_per_block
    return runs.select((F.col("first") * per).alias("pos_lo"), (F.col("last") * per + per - 1).alias("pos_hi"))


def qualifying_rows(index: Signatures, wanted: Range) -> tuple[str, DataFrame]:
    """The path taken and the qualifying rows (pos, v).

    "scan" where most rows are candidates anyway; "ranges" where candidates form few runs: they become predicates on pos,
    which skip Parquet row groups; else "join", a semi-join on the block, whose strategy Spark picks by size.
    """
    if candidate_share(index, wanted) >= SCAN_FROM:
        return "scan", qualifying(index.column, wanted)
    ranges = candidate_ranges(index, wanted).limit(MOST_RANGES + 1).collect()
    if len(ranges) <= MOST_RANGES:
        inside = reduce(lambda a, b: a | b, (F.col("pos").between(r.pos_lo, r.pos_hi) for r in ranges), F.lit(False))
        return "ranges", qualifying(index.column, wanted).where(inside)
    return "join", index.rows(wanted)
