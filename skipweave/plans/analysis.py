"""Analysis of measured builds and queries: joins, filters, means with their standard errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running


def mean_and_error(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and se = sample deviation / sqrt(n) of a value by groups; se is null for a single row."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def derived(builds: DataFrame) -> DataFrame:
    """Values per block and stored vectors of each build."""
    return builds.withColumn("values_per_block", F.expr("block_size_bytes div type_size_bytes")).withColumn("vectors", F.expr("vectors_size_bytes div (bins div 8)"))


def with_builds(queries: DataFrame, builds: DataFrame, keys: Sequence[str] = ("label", "bins", "blocksize")) -> DataFrame:
    """Each query's row with each of its builds' columns (null without one): a row for each build of the same keys."""
    return queries.join(builds, list(keys), "left")


def bag_union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of all tables, equal ones as often as they occur; columns by name, those that a table lacks are null."""
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def among(df: DataFrame, column: str, others: DataFrame, other_column: str) -> DataFrame:
    """The rows whose value is among the other table's."""
    other = others.select(F.col(other_column).alias("__among"))
    return df.join(other, df[column] == other["__among"], "left_semi")


def breaks(df: DataFrame, column: str) -> DataFrame:
    """The distinct values in order."""
    return df.select(column).distinct().orderBy(column)


def head(df: DataFrame, by: Sequence[str], n: int = 6) -> DataFrame:
    """The first rows by an order; a top-k, so no task sorts all rows."""
    return df.orderBy(*by).limit(n)


def measured(df: DataFrame, least_usec: int = 1000) -> DataFrame:
    """Builds that took long enough to be compared."""
    return df.where(F.col("time_creation_usec") > least_usec)


def cost(builds: DataFrame) -> DataFrame:
    """Microseconds for a thousand records of each build."""
    return builds.withColumn("usec_per_1000", F.col("time_creation_usec") * 1000.0 / F.col("records"))


def per_1000_vectors(joined: DataFrame, least_vectors: int = 1000) -> DataFrame:
    return joined.where(F.col("vectors") > least_vectors).withColumn("time_per_1000", F.col("query_time") * 1000.0 / F.col("vectors"))


def improvement(metrics: DataFrame, base: str = "scan") -> DataFrame:
    """(query, method, factor): time of the base path over that of each other."""
    own = metrics.where(F.col("method") == base).select("query", F.col("usec").alias("base_usec"))
    return metrics.where(F.col("method") != base).join(own, "query").select("query", "method", (F.col("base_usec") / F.col("usec")).alias("factor"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """(value, n_upto): how many rows have at most each value, by ranges of the distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, value, "n", "before").select(value, (F.col("before") + F.col("n")).alias("n_upto"))
