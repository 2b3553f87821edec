"""Sources as lazy DataFrames: JDBC tables and queries, Parquet, JSON and CSV files, catalog tables, SQL over views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.config import JobConfig
from keelson.functions.values import any_of
from keelson.operators.splits import Plan, Shard
from keelson.sources.dialects import by_name, by_url


def _jdbc_options(cfg: JobConfig) -> dict[str, str]:
    own = dict(by_name(cfg.source.type).options)
    own |= {"user": cfg.source.user, "password": cfg.source.password, "fetchsize": str(cfg.incremental.fetch_size), "queryTimeout": str(cfg.incremental.query_timeout_seconds)}
    return {k: v for k, v in own.items() if v != ""}


def from_clause(cfg: JobConfig) -> str:
    """The table, or the query as a derived table: predicates are put outside, and Catalyst and the database push them in."""
    return cfg.read.table if cfg.read.mode == "table" else f"({cfg.read.query}) keelson_source"


def is_jdbc(cfg: JobConfig) -> bool:
    return cfg.source.url.startswith("jdbc:")


def read(spark: SparkSession, cfg: JobConfig, plan: Plan | None = None, shards: list[Shard] | None = None) -> DataFrame:
    """The configured rows and columns, of all shards of the plan or of some. For JDBC each is one partition, read by one query that has its predicate."""
    if is_jdbc(cfg):
        options = _jdbc_options(cfg)
        own = shards if shards is not None else list(plan.shards) if plan is not None else []
        if own and (shards is not None or len(own) > 1):
            dialect = by_url(cfg.source.url)
            df = spark.read.jdbc(cfg.source.url, from_clause(cfg), predicates=[dialect.shard(s) for s in own], properties=options)
        else:
            df = spark.read.jdbc(cfg.source.url, from_clause(cfg), properties=options)
    elif cfg.read.mode == "query":
        df = spark.sql(cfg.read.query)
    else:
        df = _table(spark, cfg)
    if shards is not None and not is_jdbc(cfg):
        df = df.where(any_of([s.predicate() for s in shards]))
    if cfg.read.filter:
        df = df.where(cfg.read.filter)
    return df.select(*cfg.read.columns) if cfg.read.columns else df


def _table(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    kind, base = cfg.source.type, cfg.source.url
    if kind in ("parquet", "json", "csv", "orc"):
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        return reader.load(f"{base.rstrip('/')}/{cfg.read.table}")
    return spark.table(cfg.read.table)


def key_window(df: DataFrame, key: str, after: object = None, upto: object = None) -> DataFrame:
    """after < key <= upto; None leaves that side open."""
    out = df if after is None else df.where(F.col(key) > F.lit(after))
    return out if upto is None else out.where(F.col(key) <= F.lit(upto))


def key_set(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys alone, each once: nothing else is read."""
    return df.select(*keys).distinct()


def indexed_columns(spark: SparkSession, cfg: JobConfig) -> set[str] | None:
    """Leading columns of the table's indexes, in lower case; None where the source cannot tell (files, queries)."""
    if not is_jdbc(cfg) or cfg.read.mode == "query":
        return None
    try:
        c = spark._jvm.java.sql.DriverManager.getConnection(cfg.source.url, cfg.source.user, cfg.source.password)
        try:
            schema, _, table = cfg.read.table.rpartition(".")
            out, meta = set(), c.getMetaData()
            for name in {table, table.upper(), table.lower()}:
                rows = meta.getIndexInfo(None, schema or None, name, False, True)
                while rows.next():
                    if rows.getShort("ORDINAL_POSITION") == 1 and rows.getString("COLUMN_NAME"):
                        out.add(rows.getString("COLUMN_NAME").lower())
            return out
        finally:
            c.close()
    except Exception:  # metadata is a courtesy of the driver; without it nothing is said about indexes
        return None
