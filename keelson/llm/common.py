"""Shared helpers: tables, the folder that all executors see, files in it."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, with its file system: spark.checkpoint.dir.

    Only where that is unset and driver and executors are one machine, as in tests, a local folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        found = made.rpartition("/")[0] if made else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keelson-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    at = spark._jvm.org.apache.hadoop.fs.Path(found)  # without a scheme it is on the default file system, for Spark and for us
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/keelson/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove the files of materialised frames that nothing reads any more."""
    for df in written:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def put(path: str, content: bytes) -> None:
    """Write a whole file; a retried or doubled task replaces it with the same bytes."""
    fs, at = store(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    temp = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(content)
    fs.move(temp, at)


#: Rows of a batch that Python gets at a time; whole texts make them large.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held at BATCH_ROWS rows: memory of the JVM and of Python workers follows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
