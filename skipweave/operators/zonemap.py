"""Smallest and largest value of each block of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column, block_id
from .scan import Range, qualifying

FULL, PARTIAL, SKIP = "full", "partial", "skip"


@dataclass
class Zonemap:
    """zones: (zone_id, zmin, zmax, n_rows, n_values); a zone without values has null ends and is always skipped."""

    column: Column
    values_per_zone: int
    zones: DataFrame

    def classify(self, wanted: Range) -> DataFrame:
        least, most = F.col("zmin"), F.col("zmax")
        verdict = F.when(least.isNull() | wanted.misses(least, most), SKIP).when(wanted.covers(least, most), FULL).otherwise(PARTIAL)
        return self.zones.withColumn("verdict", verdict)

    def count(self, wanted: Range) -> DataFrame:
        """Values of full zones are counted from the zonemap, those of partial zones are read and checked: one pass over the
        zones, which meet the qualifying values of each zone, counted where they are read."""
        found = qualifying(self.column, wanted).groupBy(block_id(self.values_per_zone).alias("zone_id")).agg(F.count(F.lit(1)).alias("hits"))
        n = F.when(F.col("verdict") == FULL, F.col("n_values")).when(F.col("verdict") == PARTIAL, F.col("hits"))
        return self.classify(wanted).where(F.col("verdict") != SKIP).join(found, "zone_id", "left").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))

    def positions(self, wanted: Range) -> DataFrame:
        return self._rows(wanted).select("pos").orderBy("pos")

    def sum(self, wanted: Range) -> DataFrame:
        return self._rows(wanted).agg(F.sum("v").alias("total"))

    def _rows(self, wanted: Range) -> DataFrame:
        zones = self.classify(wanted).where(F.col("verdict") != SKIP).select("zone_id")
        return qualifying(self.column, wanted).withColumn("zone_id", block_id(self.values_per_zone)).join(zones, "zone_id", "left_semi")


def build_zonemap(column: Column, block_bytes: int = 64) -> Zonemap:
    """One partial aggregation by zone; zones of block_bytes bytes of values."""
    per_zone = column.type.values_per_block(block_bytes)
    zones = column.rows.groupBy(block_id(per_zone).alias("zone_id")).agg(F.min("v").alias("zmin"), F.max("v").alias("zmax"), F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"))
    return Zonemap(column, per_zone, zones)
