"""Text logs of measured runs: "create" and "query" lines of key=value fields, each run ended by a line of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "end of run"
UNSUPPORTED = r"^type .* not supported"

#: Fields of the lines and their types.
CREATE = {
    "label": "string", "exp": "string", "bins": "int", "blocksize": "int", "time_creation_usec": "bigint", "data_size_bytes": "bigint",
    "type_size_bytes": "int", "vectors_size_bytes": "bigint", "records": "bigint",
}
QUERY = {
    "label": "string", "exp": "string", "query": "int", "bins": "int", "blocksize": "int", "result_size": "bigint", "selectivity": "double",
    "query_time": "bigint", "records": "bigint",
}


def lines_of(df: DataFrame, kind: str, run: str) -> DataFrame:
    """(run, line): a row of fields as a log line."""
    fields = F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns))
    return df.select(F.lit(run).alias("run"), F.concat(F.lit(f"{kind} "), fields).alias("line"))


def parse(lines: DataFrame, fields: dict[str, str], kind: str) -> DataFrame:
    """(run_no, fields) of a kind's lines. lines: (line_no, value) in the order of the file; runs are numbered by the end
    lines before them. A field that a line lacks is null."""
    kept = lines.where(~F.col("value").rlike(UNSUPPORTED))
    ends = F.sum((F.col("value") == END).cast("int")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = kept.withColumn("run_no", ends).where(F.col("value").startswith(f"{kind} "))
    field = lambda f: F.expr(f"try_cast(nullif(regexp_extract(value, '(?:^| ){f}=([^ ]*)', 1), '') as {fields[f]})").alias(f)
    return own.select("file", "run_no", *(field(f) for f in fields))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value); a file's lines are numbered within it by one task, files in parallel."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> ''")


def numbers(lines: DataFrame) -> DataFrame:
    """(file, line_no, nth, number): every number of each line."""
    return lines.select("file", "line_no", F.posexplode(F.regexp_extract_all("value", F.lit(r"(-?\d+(?:\.\d+)?)"), 1)).alias("nth", "text")).select("file", "line_no", "nth", F.col("text").cast("double").alias("number"))
