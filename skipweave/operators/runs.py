"""Run-length form of block signatures: stored vectors and a dictionary of entries.

A run of equal signatures is stored once under a repeated entry; single signatures in a row share one entry that is not
repeated. The rule needs the order of blocks. To keep tasks bounded, blocks are cut into segments of a fixed number, and
runs end at a segment's end; with one segment the form is that of a single sequential pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from .signature import Signatures

#: Blocks of an entry, at most: the counter has 24 bits.
MOST_BLOCKS = (1 << 24) - 1
#: Blocks that one task orders.
SEGMENT = 1 << 22


@dataclass
class Runs:
    """vectors: (segment, vector_id, block_lo, length, words): a row per stored vector, in order. entries: (segment,
    entry_id, blocks, repeated, block_lo, vector_lo)."""

    vectors: DataFrame
    entries: DataFrame
    words: list[str]

    def expand(self) -> DataFrame:
        """(block_id, words): the signatures again, from entries and vectors."""
        of = self.entries.select("segment", "entry_id", "repeated", "blocks", "block_lo", "vector_lo")
        n_vectors = F.when(F.col("repeated"), 1).otherwise(F.col("blocks"))
        each = of.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n_vectors.cast("bigint") - 1)))
        placed = each.select("segment", (F.col("vector_lo") + F.col("k")).alias("vector_id"), (F.col("block_lo") + F.col("k")).alias("first"), F.when(F.col("repeated"), F.col("blocks")).otherwise(1).alias("many"))
        joined = placed.join(self.vectors.select("segment", "vector_id", *self.words), ["segment", "vector_id"])
        return joined.select(F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("block_id"), *self.words)

    def intervals(self) -> DataFrame:
        """(block_lo, block_hi, words) of each stored vector: one test decides a whole run."""
        return self.vectors.select("block_lo", (F.col("block_lo") + F.col("length") - 1).alias("block_hi"), *self.words)


def run_lengths(index: Signatures, segment: int = SEGMENT, most: int = MOST_BLOCKS) -> Runs:
    """Gaps and islands: number the runs, cut them at `most` blocks, then group neighbouring single vectors."""
    words = index.words
    in_order = Window.partitionBy("segment").orderBy("block_id")
    same = F.lit(True)
    for w in words:
        same = same & (F.col(w) == F.lag(w).over(in_order))
    blocks = index.blocks.withColumn("segment", F.expr(f"block_id div {segment}"))
    blocks = blocks.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    blocks = blocks.withColumn("run", F.sum("starts").over(in_order))
    in_run = Window.partitionBy("segment", "run").orderBy("block_id")
    blocks = blocks.withColumn("part", F.floor((F.row_number().over(in_run) - 1) / most))
    vectors = blocks.groupBy("segment", "run", "part", *words).agg(F.min("block_id").alias("block_lo"), F.count(F.lit(1)).alias("length"))
    by_vector = Window.partitionBy("segment").orderBy("block_lo")
    vectors = vectors.withColumn("vector_id", F.row_number().over(by_vector).cast("bigint") - 1).withColumn("repeated", F.col("length") > 1)
    opens = F.when(F.col("repeated") | F.coalesce(F.lag("repeated").over(by_vector), F.lit(True)), 1).otherwise(0)
    vectors = vectors.withColumn("entry_id", F.sum(opens).over(by_vector) - 1)
    singles = Window.partitionBy("segment", "entry_id").orderBy("block_lo")
    vectors = vectors.withColumn("cut", F.floor((F.row_number().over(singles) - 1) / most))
    entries = vectors.groupBy("segment", "entry_id", "cut", "repeated").agg(F.sum("length").alias("blocks"), F.min("block_lo").alias("block_lo"), F.min("vector_id").alias("vector_lo"))
    entries = entries.withColumn("entry_id", F.row_number().over(Window.partitionBy("segment").orderBy("block_lo")).cast("bigint") - 1).drop("cut")
    return Runs(vectors.select("segment", "vector_id", "block_lo", "length", *words), entries, words)


def differences(one: Runs, other: Runs) -> DataFrame:
    """Entries and vectors that only one of two indexes has: (side, part, id, value)."""

    def rows(runs: Runs) -> tuple[DataFrame, DataFrame]:
        text = F.concat_ws(",", *(F.hex(w) for w in runs.words))
        return (
            runs.entries.select(F.lit("entry").alias("part"), F.col("block_lo").alias("id"), F.concat_ws("x", F.col("blocks").cast("string"), F.col("repeated").cast("string")).alias("value")),
            runs.vectors.select(F.lit("vector").alias("part"), F.col("block_lo").alias("id"), text.alias("value")),
        )

    (e1, v1), (e2, v2) = rows(one), rows(other)
    left, right = e1.union(v1), e2.union(v2)
    return left.exceptAll(right).withColumn("side", F.lit("one")).union(right.exceptAll(left).withColumn("side", F.lit("other")))


def size_of(index: Signatures, runs: Runs) -> DataFrame:
    """n_vectors, n_entries, index_bytes (vectors and 4 bytes an entry) and percent of the column's bytes, rounded down."""
    vectors = runs.vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    entries = runs.entries.agg(F.count(F.lit(1)).alias("n_entries"))
    rows = index.column.rows.agg(F.count(F.lit(1)).alias("n_rows"))
    size = vectors.join(entries).join(rows)  # three single rows
    size = size.withColumn("index_bytes", F.col("n_vectors") * (len(index.bins) // 8) + F.col("n_entries") * 4)
    return size.select("n_vectors", "n_entries", "index_bytes", F.expr(f"index_bytes * 100 div (n_rows * {index.column.type.width})").alias("percent"))


