"""Reconciliation of a source and a target by primary key, and soft deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.values import OP, any_of, same

DEFAULT_TRUE = ("1", "true", "y")


def diff(source: DataFrame, target: DataFrame, keys: list[str], compare: bool = True) -> DataFrame:
    """Every key that needs a change: the source's columns and ``_op``: i (only in source), u (differs), d (only in target; key columns only).

    One full outer join on the keys, null-safe, of any number of key columns. Contents are compared over the columns of
    both sides; a column that a side lacks is NULL there.
    """
    return classify(source, target, keys, compare).where(F.col(OP) != "=")


def classify(source: DataFrame, target: DataFrame, keys: list[str], compare: bool = True) -> DataFrame:
    """``diff`` with the unchanged keys as well, with ``_op`` "="."""
    if not keys:
        raise ValueError("a diff needs a primary key")
    source, target = source.drop(OP), target.drop(OP)
    others = [c for c in dict.fromkeys([*source.columns, *target.columns]) if c not in keys]
    s = source.select(F.struct(*map(F.col, source.columns)).alias("s"), *(F.col(k).alias(f"s_{i}") for i, k in enumerate(keys)))
    t = target.select(F.struct(*map(F.col, target.columns)).alias("t"), *(F.col(k).alias(f"t_{i}") for i, k in enumerate(keys)))
    on = [same(F.col(f"s_{i}"), source.schema[k].dataType, F.col(f"t_{i}"), target.schema[k].dataType) for i, k in enumerate(keys)]
    both = s.join(t, on, "full_outer")

    def side(name: str, df: DataFrame, c: str) -> tuple[Column, T.DataType]:
        return (F.col(name)[c], df.schema[c].dataType) if c in df.columns else (F.lit(None), T.NullType())

    differs = []
    if compare:
        for c in others:
            (a, a_type), (b, b_type) = side("s", source, c), side("t", target, c)
            equal = a.isNull() & b.isNull() if T.NullType() in (a_type, b_type) else same(a, a_type, b, b_type)
            differs.append(~equal)
    op = F.when(F.col("t").isNull(), "i").when(F.col("s").isNull(), "d").when(any_of(differs), "u").otherwise("=")
    keyed = {k: F.coalesce(F.col("s")[k], F.col("t")[k].cast(source.schema[k].dataType)) for k in keys}
    return both.select(*((keyed[c] if c in keyed else F.col("s")[c]).alias(c) for c in source.columns), op.alias(OP))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many (keys, n): a diff pairs each such row with each of the other side. A key with a NULL counts as well."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary(classified: DataFrame) -> DataFrame:
    """One row: inserts, rewrites, deletes, unchanged."""
    count = lambda op: F.count(F.when(F.col(OP) == op, 1)).alias
    return classified.agg(count("i")("inserts"), count("u")("rewrites"), count("d")("deletes"), count("=")("unchanged"))


def key_diff(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys only, from both sides: (keys, side) with side source_only or target_only."""
    only = lambda a, b, name: a.select(*keys).distinct().alias("a").join(b.select(*keys).distinct().alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti").withColumn("side", F.lit(name))
    return only(source, target, "source_only").unionByName(only(target, source, "target_only"))


def is_deleted(column: Column, kind: T.DataType, true_values: list[str] | None = None) -> Column:
    """Whether a soft-delete flag says deleted. NULL does not.

    Given values win: the flag's text, trimmed, is one of them in any case. Else a boolean says itself, a number is
    not 0 in its whole part, and a text is 1, true or y in any case.
    """
    text = F.lower(F.trim(column.cast("string")))
    if true_values:
        said = text.isin([v.strip().lower() for v in true_values])
    elif isinstance(kind, T.BooleanType):
        said = column
    elif isinstance(kind, T.NumericType):
        said = F.when(column < 0, F.ceil(column)).otherwise(F.floor(column)) != 0
    else:
        said = text.isin(list(DEFAULT_TRUE))
    return F.coalesce(said, F.lit(False))


def soft_deletes(df: DataFrame, column: str, true_values: list[str] | None = None) -> DataFrame:
    """The rows whose flag says deleted, whole, with ``_op`` d."""
    return df.where(is_deleted(F.col(column), df.schema[column].dataType, true_values)).withColumn(OP, F.lit("d"))
