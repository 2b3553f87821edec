"""Values of rows: a canonical text form, equality across types, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OP = "_op"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def normalize(column: Column, kind: T.DataType) -> Column:
    """One text for equal values of different types: numbers plain and without trailing zeros, times as epoch microseconds.

    A text that reads as a timestamp has that timestamp's form; NULL stays NULL.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        exact = F.expr("CAST(NULL AS STRING)")
        plain = _plain(column.try_cast("decimal(38,12)"))
        return F.when(F.isnan(column) | column.isin(float("inf"), float("-inf")), column.cast("string")).otherwise(F.coalesce(plain, column.cast("string"), exact))
    if isinstance(kind, _NUMBERS):
        return _plain(column)
    if isinstance(kind, _TIMES):
        return _micros(column)
    if isinstance(kind, T.DateType):
        return column.cast("string")
    if isinstance(kind, T.BooleanType):
        return column.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, T.StringType):
        stamp = F.when(column.rlike(r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), column.try_cast("timestamp_ntz"))
        return F.coalesce(_micros(stamp), column)
    return F.to_json(column)


def _plain(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp")).cast("string")


def same(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Null-safe equality. Equal types, and numbers of any types, are compared as they are; others by their canonical text."""
    if a_type == b_type or isinstance(a_type, _NUMBERS) and isinstance(b_type, _NUMBERS) or isinstance(a_type, _TIMES) and isinstance(b_type, _TIMES):
        return a.eqNullSafe(b)
    return normalize(a, a_type).eqNullSafe(normalize(b, b_type))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 64-bit hash of the columns' values in schema order; NULLs and column order count."""
    names = columns or [c for c in df.columns if c != OP]
    parts = [F.coalesce(normalize(F.col(c), df.schema[c].dataType), F.lit("\0")) for c in names]
    return F.xxhash64(*parts)


def portable_hash(*columns: Column) -> Column:
    """60 bits of an MD5 of the columns' texts: the same number in any engine."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("\0")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
