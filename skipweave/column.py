"""A column as (pos, v): row positions and values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types


@dataclass
class Column:
    """rows: (pos bigint, v), pos being 0..n-1 without gaps; type: of v."""

    rows: DataFrame
    type: types.ColumnType
    name: str

    _n: int | None = None
    #: (pos, v, raw): the rows with the stored value that v was made from, and its type.
    stored: tuple[DataFrame, T.DataType] | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.rows.count()
        return self._n

    def between(self, low, high) -> DataFrame:
        """rows without some of those whose values lie outside low..high; the comparison reaches the Parquet reader."""
        if self.stored is None:
            return self.rows
        df, field = self.stored
        for limit, holds in zip(types.raw_limits(field, low, high), (F.col("raw").__ge__, F.col("raw").__le__)):
            if limit is not None:
                df = df.where(holds(limit))
        return df.select("pos", "v")


def column(df: DataFrame, value: str, pos: str) -> Column:
    """The column `value` of df, whose unique key `pos` runs from 0 to n-1. Null and NaN values keep their position."""
    field = df.schema[value].dataType
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), types.value_of(F.col(value), field).alias("v"), F.col(value).alias("raw"))
    return Column(rows.select("pos", "v"), types.of_field(field), value, stored=(rows, field))


def coded_column(df: DataFrame, value: str, pos: str) -> tuple[Column, DataFrame]:
    """A string column as order-preserving codes, and its dictionary (text, code)."""
    codes = types.dictionary(df, value)
    kind = types.code_type(codes.count())
    rows = df.select(F.col(pos).cast("bigint").alias("pos"), F.col(value).alias("text")).join(codes, "text", "left").select("pos", F.col("code").cast(kind.spark).alias("v"))
    return Column(rows, kind, value), codes


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with pos, the row's number over all its files in the order of their paths.

    Files are counted first (a row per file comes to the driver); then each row's number within its file is shifted by
    the rows of the files before.
    """
    df = spark.read.parquet(path)
    sizes = {r.f: r.n for r in df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) <= 1:
        return df.withColumn("pos", F.col("_metadata.row_index"))
    starts, at = [], 0
    for f in sorted(sizes):
        starts.append((f, at))
        at += sizes[f]
    before = spark.createDataFrame(starts, "file string, before bigint")
    tagged = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return tagged.join(before, "file").withColumn("pos", F.col("before") + F.col("row_index")).drop("file", "row_index", "before")


def block_id(values_per_block: int):
    """Number of the block that a row's pos lies in."""
    return F.expr(f"pos div {int(values_per_block)}")
