"""Fingerprints of row sets: count and an order-free hash, of a table or of its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.values import row_hash


def _summary(h: Column) -> list[Column]:
    # XOR alone cannot tell a row that is there twice from one that is not there; the sum can
    return [F.count(F.lit(1)).alias("row_count"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum")]


def window(df: DataFrame, column: str, lo: object = None, hi: object = None) -> DataFrame:
    """lo <= column < hi; None leaves that side open."""
    out = df if lo is None else df.where(F.col(column) >= F.lit(lo))
    return out if hi is None else out.where(F.col(column) < F.lit(hi))


def table(df: DataFrame, columns: list[str] | None = None, hashed: Column | None = None) -> DataFrame:
    """One row: row_count, hash_xor, hash_sum. Columns are taken in schema order; ``hashed`` is another hash of a row than row_hash."""
    return df.agg(*_summary(row_hash(df, columns) if hashed is None else hashed))


def by_partition(df: DataFrame, partition: Column, columns: list[str] | None = None, hashed: Column | None = None) -> DataFrame:
    """The same for each value of ``partition``: (part, row_count, hash_xor, hash_sum)."""
    return df.groupBy(partition.alias("part")).agg(*_summary(row_hash(df, columns) if hashed is None else hashed))


def partition_of(df: DataFrame, column: str) -> Column:
    """The value that rows are partitioned by: the day of a time, else the column itself; one for all without a column."""
    if not column:
        return F.lit(0)
    return F.to_date(column) if df.schema[column].dataType.simpleString().startswith("timestamp") else F.col(column)


def moved(source: DataFrame, target: DataFrame, column: str = "") -> tuple[DataFrame, DataFrame]:
    """The rows of both sides whose partitions have different fingerprints: what a diff has to look at. Both have the same columns."""
    parts = changed(by_partition(source, partition_of(source, column)), by_partition(target, partition_of(target, column))).select("part")
    own = lambda df: df.withColumn("_part", partition_of(df, column)).join(parts, F.col("_part").eqNullSafe(F.col("part")), "left_semi").drop("_part")
    return own(source), own(target)


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Partitions that are new, gone or different: (part, state)."""
    a, b = now.alias("a"), before.alias("b")
    equal = (F.col("a.row_count") == F.col("b.row_count")) & F.col("a.hash_xor").eqNullSafe(F.col("b.hash_xor")) & F.col("a.hash_sum").eqNullSafe(F.col("b.hash_sum"))
    state = F.when(F.col("b.row_count").isNull(), "new").when(F.col("a.row_count").isNull(), "gone").when(~equal, "changed").otherwise("same")
    return a.join(b, F.col("a.part").eqNullSafe(F.col("b.part")), "full_outer").select(F.coalesce("a.part", "b.part").alias("part"), state.alias("state")).where("state != 'same'")


def text(row: object) -> str:
    """A fingerprint as stored."""
    return f"{row['row_count']}:{row['hash_xor']}:{row['hash_sum']}"
