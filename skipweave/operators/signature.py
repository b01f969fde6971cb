"""Block signatures: for each block of rows, the set of bins in which it has a value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column, block_id
from ..functions import bits
from ..functions.binning import Bins, bins_of
from .scan import Range, qualifying
from .zonemap import FULL, PARTIAL, SKIP


@dataclass
class Signatures:
    """blocks: (block_id, n_rows, n_values, w0, w1, ...), the words holding the blocks' bins."""

    column: Column
    bins: Bins
    values_per_block: int
    blocks: DataFrame

    @property
    def words(self) -> list[str]:
        return bits.word_names(len(self.bins))

    def masks(self, wanted: Range) -> tuple[list[int], list[int]]:
        """The bins that the range touches, and those strictly between its ends, whose values all qualify."""
        low, high = self.bins.find(wanted.low), self.bins.find(wanted.high)
        if low > high:
            return bits.words_of(0, len(self.bins)), bits.words_of(0, len(self.bins))
        outer = (1 << high + 1) - (1 << low)
        inner = (1 << high) - (1 << low + 1) if high > low + 1 else 0
        return bits.words_of(outer, len(self.bins)), bits.words_of(inner, len(self.bins))

    def classify(self, wanted: Range) -> DataFrame:
        """blocks with a verdict: skip, full (no value needs a check) or partial. Blocks without values are skipped."""
        return self.blocks.withColumn("verdict", self.verdict(wanted))

    def verdict(self, wanted: Range) -> SparkColumn:
        outer, inner = self.masks(wanted)
        return F.when(~bits.any_common(self.words, outer), SKIP).when(bits.all_within(self.words, inner), FULL).otherwise(PARTIAL)

    def rows(self, wanted: Range) -> DataFrame:
        """The qualifying rows (pos, v), looked for in candidate blocks only; the range reaches the Parquet reader too."""
        blocks = self.classify(wanted).where(F.col("verdict") != SKIP).select("block_id")
        return qualifying(self.column, wanted).withColumn("block_id", block_id(self.values_per_block)).join(blocks, "block_id", "left_semi").select("pos", "v")

    def count(self, wanted: Range) -> DataFrame:
        """Values of full blocks are counted from the index, those of partial blocks are read and checked: one pass over the
        blocks, which meet the qualifying values of each block, counted where they are read."""
        found = qualifying(self.column, wanted).groupBy(block_id(self.values_per_block).alias("block_id")).agg(F.count(F.lit(1)).alias("hits"))
        n = F.when(F.col("verdict") == FULL, F.col("n_values")).when(F.col("verdict") == PARTIAL, F.col("hits"))
        return self.classify(wanted).where(F.col("verdict") != SKIP).join(found, "block_id", "left").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))

    def counts(self, ranges: Sequence[Range]) -> DataFrame:
        """A row of counts n0, n1, ... of several ranges, by one pass over the blocks and one over the rows."""
        hits = [F.count_if(r.holds(F.col("v"))).alias(f"h{k}") for k, r in enumerate(ranges)]
        found = self.column.rows.groupBy(block_id(self.values_per_block).alias("block_id")).agg(*hits)
        n = [F.when(self.verdict(r) == FULL, F.col("n_values")).when(self.verdict(r) == PARTIAL, F.col(f"h{k}")) for k, r in enumerate(ranges)]
        return self.blocks.join(found, "block_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}") for k, c in enumerate(n)))

    def positions(self, wanted: Range) -> DataFrame:
        return self.rows(wanted).select("pos").orderBy("pos")

    def sum(self, wanted: Range) -> DataFrame:
        return self.rows(wanted).agg(F.sum("v").alias("total"))

    def coarser(self, blocks: int) -> Signatures:
        """A second level: the union of each `blocks` signatures in a row."""
        merged = self.blocks.groupBy(F.expr(f"block_id div {blocks}").alias("block_id")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), *(F.bit_or(w).alias(w) for w in self.words))
        return Signatures(self.column, self.bins, self.values_per_block * blocks, merged)


def block_signatures(rows: DataFrame, bins: Bins, values_per_block: int) -> DataFrame:
    """Blocks of rows (pos, v): one partial aggregation of bit_or by block."""
    binned = rows.select(block_id(values_per_block).alias("block_id"), "v", bins.bin_of(F.col("v")).alias("bin"))
    zero = F.lit(0).cast("bigint")
    words = [F.coalesce(F.bit_or(bits.bit(F.col("bin"), k)), zero).alias(w) for k, w in enumerate(bits.word_names(len(bins)))]
    return binned.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"), *words)


def build_signatures(column: Column, block_bytes: int = 64, most_bins: int = 64, bins: Bins | None = None) -> Signatures:
    """An index over blocks of block_bytes bytes of values, with up to most_bins bins from the column's sample."""
    bins = bins or bins_of(column, most_bins)
    per_block = column.type.values_per_block(block_bytes)
    return Signatures(column, bins, per_block, block_signatures(column.rows, bins, per_block))
