"""Applying changes to a target, and additive schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.values import OP


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last in ``order``; the order should be total for a repeatable result."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order)))
    return df.withColumn("_rn", number).where("_rn = 1").drop("_rn")


def is_delete(df: DataFrame) -> Column:
    """``_op`` d or delete, in any case; rows of a frame without it are upserts."""
    return F.coalesce(F.lower(OP).isin("d", "delete"), F.lit(False)) if OP in df.columns else F.lit(False)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The target after upserts and deletes; columns that only the changes have are added.

    The last change of a key wins, whether upsert or delete: by ``order``, else deletes come after upserts.
    Applying the same changes again gives the same target. Both sides are read once: they meet in one shuffle on the
    keys, where a change comes before the target's rows of its key and replaces them.
    """
    if not keys:
        raise ValueError("a merge needs a primary key")
    order = order or [is_delete(changes).cast("int"), F.to_json(F.struct(*map(F.col, changes.columns)))]
    ranks = {f"_rank{i}": c for i, c in enumerate(order)}
    own = changes.withColumns({**ranks, "_gone": is_delete(changes), "_new": F.lit(1)}).drop(OP)
    both = target.drop(OP).withColumn("_new", F.lit(0)).unionByName(own, allowMissingColumns=True)
    run = W.partitionBy(*keys).orderBy(F.desc("_new"), *(F.col(c).desc_nulls_last() for c in ranks))
    both = both.withColumn("_at", F.row_number().over(run)).withColumn("_changed", F.max("_new").over(run))
    kept = (F.col("_changed") == 0) | ((F.col("_new") == 1) & (F.col("_at") == 1) & ~F.col("_gone"))
    return both.where(kept).drop(*ranks, "_gone", "_new", "_at", "_changed")


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.drop(OP), allowMissingColumns=True)


def missing_columns(source: T.StructType, target: T.StructType) -> list[T.StructField]:
    """Fields that the target lacks, whatever the case of their names. Nothing is ever dropped or narrowed."""
    have = {f.name.lower() for f in target.fields}
    return [f for f in source.fields if f.name.lower() not in have and f.name != OP]


def evolve(target: DataFrame, source: T.StructType) -> DataFrame:
    """The target with the missing columns, NULL."""
    return target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing_columns(source, target.schema)})


def column_type(kind: T.DataType) -> str:
    """The type of a column added to a database table."""
    if isinstance(kind, T.LongType):
        return "BIGINT"
    if isinstance(kind, T.IntegralType):
        return "INT"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.FractionalType):
        return "DOUBLE"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.DateType):
        return "DATE"
    return "TIMESTAMP" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "VARCHAR(1024)"
