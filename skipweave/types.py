"""Column types: widths, limits and the value by which a column is ordered."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.ordered import running


@dataclass(frozen=True)
class ColumnType:
    """A fixed-width type: bytes of a value, Spark's type for it, and its limits."""

    name: str
    width: int
    spark: str
    least: float | int
    most: float | int

    @property
    def floating(self) -> bool:
        return self.spark in ("float", "double")

    def values_per_block(self, block_bytes: int) -> int:
        if block_bytes < self.width:
            raise ValueError(f"a block of {block_bytes} bytes holds no value of {self.width}")
        return block_bytes // self.width


BYTE = ColumnType("tinyint", 1, "tinyint", -128, 127)
SHORT = ColumnType("smallint", 2, "smallint", -(2**15), 2**15 - 1)
INT = ColumnType("int", 4, "int", -(2**31), 2**31 - 1)
LONG = ColumnType("long", 8, "bigint", -(2**63), 2**63 - 1)
REAL = ColumnType("float", 4, "float", -3.4028234663852886e38, 3.4028234663852886e38)
DOUBLE = ColumnType("double", 8, "double", -1.7976931348623157e308, 1.7976931348623157e308)
OID = ColumnType("oid", 8, "decimal(20,0)", 0, 2**64 - 1)

#: Type names of declared raw columns; fixed values.
NAMES = {
    "tinyint": BYTE, "boolean": BYTE,
    "char": SHORT, "smallint": SHORT, "short": SHORT,
    "decimal": INT, "int": INT, "date": INT,
    "long": LONG, "bigint": LONG,
    "float": REAL, "real": REAL,
    "double": DOUBLE,
    "oid": OID,
}


def resolve(name: str) -> ColumnType:
    """The type of a declared name; raises ValueError for an unknown one."""
    try:
        return NAMES[name]
    except KeyError:
        raise ValueError(f"type {name} not supported") from None


def of_field(field: T.DataType) -> ColumnType:
    """The fixed-width type by which values of a Spark type are indexed."""
    kinds = {T.ByteType: BYTE, T.BooleanType: BYTE, T.ShortType: SHORT, T.IntegerType: INT, T.DateType: INT, T.LongType: LONG, T.TimestampType: LONG, T.TimestampNTZType: LONG, T.FloatType: REAL, T.DoubleType: DOUBLE}
    if isinstance(field, T.DecimalType):
        if field.precision <= 9:
            return INT
        if field.precision <= 18:
            return LONG
        if field.precision == 20 and field.scale == 0:
            return OID
    kind = kinds.get(type(field))
    if kind is None:
        raise ValueError(f"type {field.simpleString()} not supported; string columns go through dictionary()")
    return kind


def value_of(column: Column, field: T.DataType) -> Column:
    """The column as its indexed value; NaN becomes null, so that it sets no bit and qualifies nowhere."""
    if isinstance(field, T.BooleanType):
        return column.cast("tinyint")
    if isinstance(field, T.DateType):
        return F.unix_date(column)
    if isinstance(field, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(field, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)
    if isinstance(field, T.DecimalType) and field.precision <= 18:
        unscaled = column * F.lit(10**field.scale).cast(f"decimal({field.scale + 1},0)")
        return unscaled.cast("int" if field.precision <= 9 else "bigint")
    if isinstance(field, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def raw_limits(field: T.DataType, low, high) -> tuple[Column | None, Column | None]:
    """Literals of the column's own type between which every value of the indexed range low..high lies, both included (None:
    no such literal). Comparisons with them reach the Parquet reader, which value_of() would hide."""

    def at(limit, up: bool) -> Column | None:
        if isinstance(limit, float) and math.isnan(limit):
            return None
        if isinstance(field, T.DoubleType):
            return F.lit(float(limit))
        if isinstance(field, T.FloatType):
            if abs(limit) > REAL.most:
                return None
            return F.lit(float(np.float32(limit))).cast("float")  # no float lies between the limit and the float nearest to it
        if isinstance(limit, float) and math.isinf(limit):
            return None
        whole = math.ceil(limit) if up else math.floor(limit)
        try:
            if isinstance(field, T.DateType):
                return F.lit(date(1970, 1, 1) + timedelta(days=whole))
            if isinstance(field, T.TimestampType):
                return F.expr(f"timestamp_micros({whole}L)") if abs(whole) < 2**62 else None
            if isinstance(field, T.TimestampNTZType):
                return F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=whole)}'")
        except OverflowError:
            return None
        if isinstance(field, T.DecimalType) and abs(whole) < 10**field.precision:
            exact = Decimal(whole).scaleb(-field.scale) if field.precision <= 18 else Decimal(whole)
            return F.lit(exact).cast(field.simpleString())
        return None

    return at(low, False), at(high, True)


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """(text, code): the distinct strings of a column, numbered in order, by ranges of them."""
    texts = df.select(F.col(name).alias("text")).where("text is not null").distinct().withColumn("one", F.lit(1))
    return running(texts, "text", "one", "code").select("text", "code")


def code_type(n_codes: int) -> ColumnType:
    """The narrowest type that holds codes 0..n_codes - 1."""
    return next(t for t in (BYTE, SHORT, INT, LONG) if n_codes - 1 <= t.most)
