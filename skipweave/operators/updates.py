"""Appends, deletes and updates of an indexed column."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column, block_id
from ..functions import bits
from .scan import Range
from .signature import Signatures, block_signatures


def append(index: Signatures, rows: DataFrame) -> Signatures:
    """The index of the column with further rows (pos, v), whose positions follow. Bins stay; the first and last take
    what lies outside. Only new blocks are built; the block at the seam is the union of both parts."""
    new = block_signatures(rows, index.bins, index.values_per_block)
    return _merged(index, new, Column(index.column.rows.unionByName(rows), index.column.type, index.column.name))


def insert_bits(index: Signatures, changed: DataFrame) -> Signatures:
    """The index after the values at the positions of `changed` (pos, v; each position once, null for no value) were replaced:
    their bins are added, those of the old values stay set, which only lets more blocks be read. The numbers of values
    change by those that come and those that go."""
    zero = F.lit(0).cast("bigint")
    new = block_signatures(changed, index.bins, index.values_per_block).withColumn("n_rows", zero)
    gone = index.column.rows.join(changed.select("pos"), "pos", "left_semi").groupBy(block_id(index.values_per_block).alias("block_id"))
    new = new.unionByName(gone.agg(zero.alias("n_rows"), (-F.count("v")).alias("n_values"), *(zero.alias(w) for w in index.words)))
    rows = index.column.rows.join(changed.select("pos"), "pos", "left_anti").unionByName(changed)
    return _merged(index, new, Column(rows, index.column.type, index.column.name))


def _merged(index: Signatures, new: DataFrame, column: Column) -> Signatures:
    blocks = index.blocks.unionByName(new).groupBy("block_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), *(F.bit_or(w).alias(w) for w in index.words))
    return replace(index, column=column, blocks=blocks)


def with_deltas(positions: DataFrame, deleted: DataFrame | None = None, inserted: DataFrame | None = None, wanted: Range | None = None) -> DataFrame:
    """An index's result corrected by delta tables: deleted (pos) rows go, qualifying inserted (pos, v) rows come."""
    out = positions.select("pos")
    if deleted is not None:
        out = out.join(deleted.select("pos"), "pos", "left_anti")
    if inserted is not None:
        out = out.union(inserted.where(wanted.holds(F.col("v"))).select("pos")).distinct()
    return out.orderBy("pos")


def saturation(index: Signatures) -> DataFrame:
    """Mean share of bins set in a block: near 1, the index skips nothing and should be built anew."""
    return index.blocks.agg((F.avg(bits.popcount(F.col(w) for w in index.words)) / len(index.bins)).alias("saturation"))
