"""Rows that wait between a source and a target: written once where all executors see them, and removed afterwards."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, path: str = "") -> str:
    """The given folder, else spark.checkpoint.dir; a local folder only where driver and executors are one machine."""
    found = path or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="keelson-")
    if not found:
        raise ValueError("set runtime.stagePath or spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def staged(rows: DataFrame, path: str = "") -> Iterator[DataFrame]:
    """The rows as they were when first read; a lost executor costs no second read of the source."""
    spark = rows.sparkSession
    at = f"{folder(spark, path)}/keelson-stage/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(at)
        yield spark.read.schema(rows.schema).parquet(at)
    finally:
        remove(spark, at)
