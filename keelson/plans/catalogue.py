"""Registered queries of the synchronisation engine and their oracle SQL.

The target that diffs and merges use is made from ``orders`` alike in both engines: without every 17th key, with the
price of every 13th raised, and with a ghost key for every 19th.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.config import Incremental, JobConfig, Read, Source, Splits, from_dict
from keelson.functions.values import OP, normalize, portable_hash
from keelson.operators import cursor, diff, fingerprint, merge, quality, splits
from keelson.operators.cursor import Watermark
from keelson.sources import scan, sinks, stage
from keelson.state import FileState, RunReport, mark_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _config(sf_dir: str, **more: object) -> JobConfig:
    return JobConfig(source=Source(type="parquet", url=sf_dir), **more)


TARGET = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 17 <> 0
UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 19 = 0)"""


def ghosts_after(orders: DataFrame) -> int:
    """The first million after all keys: TARGET's shift while keys are below it, and one at which no ghost meets a key of any table."""
    last = splits.probe(orders, "o_orderkey")[1]
    return 1_000_000 * ((last or 0) // 1_000_000 + 1)


def target(orders: DataFrame, shift: int = 1_000_000) -> DataFrame:
    """TARGET. With keys of a million and more its ghosts have keys of other rows; ``ghosts_after`` is a shift without that."""
    key = F.col("o_orderkey")
    there = orders.where(key % 17 != 0).withColumn("o_totalprice", F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return there.unionByName(orders.where(key % 19 == 0).withColumn("o_orderkey", key + shift))


# ---------------------------------------------------------------- scans


@register("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE (o_orderstatus = 'F') AND (o_totalprice > 100000)")
def scan_project_filter(spark, sf_dir):
    cfg = _config(sf_dir, read=Read(table="orders.parquet", columns=["o_orderkey", "o_totalprice", "o_orderstatus"], filter="o_orderstatus = 'F' AND o_totalprice > 100000"))
    return scan.read(spark, cfg)


_JOIN = "SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"


@register("SELECT * FROM (" + _JOIN.format(orders="orders", customer="customer") + ") s WHERE o_totalprice > 200000")
def query_mode_join(spark, sf_dir):
    for t in ("orders", "customer"):
        _read(spark, sf_dir, t).createOrReplaceTempView(f"keelson_{t}")
    query = _JOIN.format(orders="keelson_orders", customer="keelson_customer")
    return scan.read(spark, _config(sf_dir, read=Read(mode="query", query=query, filter="o_totalprice > 200000")))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= 2500")
def key_window_scan(spark, sf_dir):
    return scan.key_window(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 2500)


@register("SELECT DISTINCT conv_id, turn FROM conversations")
def primary_key_set(spark, sf_dir):
    return scan.key_set(_read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


# ---------------------------------------------------------------- splits


@register("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def minmax_probe(spark, sf_dir):
    return spark.createDataFrame([splits.probe(_read(spark, sf_dir, "orders"), "o_orderkey")], "lo long, hi long")


def _by_shard(df: DataFrame, plan: splits.Plan, column: str) -> DataFrame:
    return splits.tagged(df, plan).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))


@register(
    """WITH b AS (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0) AS BIGINT) AS step FROM orders)
SELECT CAST(least(3, (o_orderkey - lo) // step) AS INTEGER) AS shard, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders, b GROUP BY 1"""
)
def split_range(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return _by_shard(orders, splits.plan(orders, "o_orderkey", 4, "range"), "o_orderkey")


@register("SELECT CAST(((k % 4) + 4) % 4 AS INTEGER) AS shard, count(*) AS n, min(k) AS lo, max(k) AS hi FROM (SELECT o_orderkey - 5000 AS k FROM orders) t GROUP BY 1")
def split_mod(spark, sf_dir):
    t = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") - 5000).alias("k"))  # negative keys as well
    return _by_shard(t, splits.plan(t, "k", 4, "mod"), "k")


@register("SELECT CAST(('0x' || substr(md5(o_orderpriority || ''), 1, 15))::BIGINT % 4 AS INTEGER) AS shard, count(*) AS n, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1")
def split_hash(spark, sf_dir):
    t = _read(spark, sf_dir, "orders")
    return _by_shard(t, splits.plan(t, "o_orderpriority", 4, "auto"), "o_orderpriority")


@register("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS null_keys FROM orders")
def split_coverage(spark, sf_dir):
    """Every row is in one shard, also rows without a key."""
    orders = _read(spark, sf_dir, "orders")
    t = orders.withColumn("k", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")))
    plan = splits.plan(t, "k", 5, "range")
    parts = [t.where(s.predicate()) for s in plan.shards]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.count(F.when(F.col("k").isNull(), 1)).alias("null_keys"))


# ---------------------------------------------------------------- cursors


@register("SELECT event_id, user_id, event_type FROM events WHERE event_id > 7000")
def incr_id(spark, sf_dir):
    inc = Incremental(strategy="id", id_column="event_id", column="ts")
    return cursor.incremental(_read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), inc, Watermark(id=7000))


_TIMED = Incremental(strategy="update_time", id_column="event_id", column="ts", overlap="1h")


@register("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR")
def incr_update_time(spark, sf_dir):
    return cursor.incremental(_read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), _TIMED, Watermark(datetime(2024, 1, 20)))


_ORDERS = Incremental(strategy="update_time_id", column="o_orderdate", id_column="o_orderkey", overlap="0s")
_AT = Watermark(datetime(1998, 1, 1), 7000)


@register("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey > 7000)")
def incr_update_time_id(spark, sf_dir):
    return cursor.incremental(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), _ORDERS, _AT)


@register("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def incr_bootstrap(spark, sf_dir):
    rows = cursor.incremental(_read(spark, sf_dir, "orders"), _ORDERS, Watermark())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@register("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id > 6600)")
def incr_overlap_late(spark, sf_dir):
    inc = Incremental(strategy="update_time_id", column="ts", id_column="event_id", overlap="PT1H")
    return cursor.incremental(_read(spark, sf_dir, "events").select("event_id", "ts"), inc, Watermark(datetime(2024, 1, 20), 6600))


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey > 7000) ORDER BY o_orderdate, o_orderkey LIMIT 200")
def incr_capped(spark, sf_dir):
    inc = Incremental(strategy="update_time_id", column="o_orderdate", id_column="o_orderkey", overlap="0s", max_rows_per_run=200)
    return cursor.incremental(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), inc, _AT)


@register("SELECT m.ts AS ts, m.id AS id FROM (SELECT max({'ts': o_orderdate, 'id': o_orderkey}) AS m FROM orders) t")
def watermark_max(spark, sf_dir):
    m = cursor.reached(_read(spark, sf_dir, "orders"), _ORDERS)
    return spark.createDataFrame([(m.ts, m.id)], "ts timestamp_ntz, id long")


@register(
    """WITH b AS (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0) AS BIGINT) AS step FROM orders),
t AS (SELECT CAST(least(3, (o_orderkey - lo) // step) AS INTEGER) AS shard, {'ts': o_orderdate, 'id': o_orderkey} AS w FROM orders, b)
SELECT shard, m.ts AS ts, m.id AS id FROM (SELECT shard, max(w) AS m FROM t GROUP BY shard) x"""
)
def watermark_by_shard(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    tagged = splits.tagged(orders, splits.plan(orders, "o_orderkey", 4))
    top = tagged.groupBy("shard").agg(F.max(F.struct(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))).alias("m"))
    return top.select("shard", "m.ts", "m.id")


# ---------------------------------------------------------------- merges

_LINE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@register(
    f"SELECT {_LINE} FROM (SELECT {_LINE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) t WHERE rn = 1"
)
def keep_latest(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(*_LINE.split(", "))
    return merge.keep_latest(rows, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])


def _merged(spark, sf_dir, op: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    there = target(orders)
    return merge.apply_changes(there, diff.diff(orders, there, ["o_orderkey"]).where(F.col(OP).isin(*op)), ["o_orderkey"])


@register(f"SELECT * FROM orders UNION ALL SELECT * FROM {TARGET} t WHERE o_orderkey >= 1000000")
def merge_upsert(spark, sf_dir):
    return _merged(spark, sf_dir, "iu")


@register(f"SELECT * FROM {TARGET} t WHERE o_orderkey < 1000000")
def merge_delete(spark, sf_dir):
    return _merged(spark, sf_dir, "d")


@register(f"SELECT o_orderkey, o_totalprice FROM {TARGET} t UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def append_only(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return merge.append(target(orders), orders).select("o_orderkey", "o_totalprice")


@register("SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def schema_add_columns(spark, sf_dir):
    customer = _read(spark, sf_dir, "customer")
    return merge.evolve(customer.select("c_custkey", "c_name"), customer.drop("c_nationkey").schema)


# ---------------------------------------------------------------- diffs


@register("SELECT doc_id, quality, toxic, 'd' AS _op FROM labels WHERE toxic <> 0")
def soft_delete_default(spark, sf_dir):
    return diff.soft_deletes(_read(spark, sf_dir, "labels"), "toxic")


@register("SELECT o_orderkey, o_orderstatus, 'd' AS _op FROM orders WHERE o_orderstatus IN ('F', 'P')")
def soft_delete_values(spark, sf_dir):
    return diff.soft_deletes(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", [" f", "P "])


def _diff(spark, sf_dir) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return diff.diff(orders, target(orders), ["o_orderkey"])


@register(f"SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM {TARGET} t WHERE t.o_orderkey = o.o_orderkey)")
def pk_diff_insert(spark, sf_dir):
    return _diff(spark, sf_dir).where(F.col(OP) == "i").select("o_orderkey", "o_totalprice")


@register(f"SELECT o_orderkey, 'd' AS _op FROM {TARGET} t WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE t.o_orderkey = o.o_orderkey)")
def pk_diff_delete(spark, sf_dir):
    return _diff(spark, sf_dir).where(F.col(OP) == "d").select("o_orderkey", OP)


@register(f"SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN {TARGET} t ON t.o_orderkey = o.o_orderkey WHERE o.o_totalprice IS DISTINCT FROM t.o_totalprice")
def pk_diff_rewrite(spark, sf_dir):
    return _diff(spark, sf_dir).where(F.col(OP) == "u").select("o_orderkey", "o_totalprice")


@register(
    f"""SELECT count(*) FILTER (WHERE t.o_orderkey IS NULL) AS inserts,
count(*) FILTER (WHERE t.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL AND o.o_totalprice IS DISTINCT FROM t.o_totalprice) AS rewrites,
count(*) FILTER (WHERE o.o_orderkey IS NULL) AS deletes,
count(*) FILTER (WHERE t.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL AND o.o_totalprice IS NOT DISTINCT FROM t.o_totalprice) AS unchanged
FROM orders o FULL OUTER JOIN {TARGET} t ON o.o_orderkey = t.o_orderkey"""
)
def pk_diff_summary(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return diff.summary(diff.classify(orders, target(orders), ["o_orderkey"]))


@register(
    """SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'i' ELSE 'u' END AS _op FROM conversations WHERE turn = 2 OR (conv_id % 5 = 0 AND turn = 0)
UNION ALL SELECT conv_id + 100000, turn, 'd' FROM conversations WHERE conv_id % 7 = 0 AND turn = 1"""
)
def pk_diff_composite(spark, sf_dir):
    source = _read(spark, sf_dir, "conversations")
    there = source.where("turn <> 2").withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.lit(None)).otherwise(F.col("text")))
    ghosts = source.where("conv_id % 7 = 0 AND turn = 1").withColumn("conv_id", F.col("conv_id") + 100_000)
    return diff.diff(source, there.unionByName(ghosts), ["conv_id", "turn"]).select("conv_id", "turn", OP)


@register("SELECT CAST(0 AS BIGINT) AS inserts, CAST(0 AS BIGINT) AS rewrites, CAST(0 AS BIGINT) AS deletes, count(*) AS unchanged FROM orders")
def pk_diff_converged(spark, sf_dir):
    """After a diff is applied, a second one finds nothing."""
    orders = _read(spark, sf_dir, "orders")
    return diff.summary(diff.classify(orders, _merged(spark, sf_dir, "iud"), ["o_orderkey"]))


@register(f"SELECT o_orderkey, 'source_only' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM {TARGET} t) a UNION ALL SELECT o_orderkey, 'target_only' FROM (SELECT o_orderkey FROM {TARGET} t EXCEPT SELECT o_orderkey FROM orders) b")
def key_set_diff(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return diff.key_diff(orders, target(orders), ["o_orderkey"])


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def pk_diff_repeated(spark, sf_dir):
    """Keys that are none."""
    return diff.repeated(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- fingerprints

_EVENT_HASH = "('0x' || substr(md5(event_id::VARCHAR || '|' || user_id::VARCHAR || '|' || event_type), 1, 15))::BIGINT"


@register(f"SELECT count(*) AS row_count, bit_xor({_EVENT_HASH}) AS hash_xor, sum({_EVENT_HASH})::VARCHAR AS hash_sum FROM events")
def fingerprint_table(spark, sf_dir):
    h = portable_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return fingerprint.table(_read(spark, sf_dir, "events"), hashed=h).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@register(f"SELECT count(*) AS row_count, bit_xor({_EVENT_HASH}) AS hash_xor, sum({_EVENT_HASH})::VARCHAR AS hash_sum FROM events WHERE event_id >= 1000 AND event_id < 3000")
def fingerprint_window(spark, sf_dir):
    h = portable_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return fingerprint.table(fingerprint.window(_read(spark, sf_dir, "events"), "event_id", 1000, 3000), hashed=h).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@register(f"SELECT CAST(ts AS DATE) AS part, count(*) AS row_count, bit_xor({_EVENT_HASH}) AS hash_xor, sum({_EVENT_HASH})::VARCHAR AS hash_sum FROM events GROUP BY 1")
def fingerprint_by_partition(spark, sf_dir):
    events, h = _read(spark, sf_dir, "events"), portable_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return fingerprint.by_partition(events, fingerprint.partition_of(events, "ts"), hashed=h).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@register("SELECT DISTINCT CAST(ts AS DATE) AS part, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-03' THEN 'new' ELSE 'changed' END AS state FROM events WHERE event_id = 4000 OR CAST(ts AS DATE) = DATE '2024-01-03'")
def fingerprint_changed(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    day = F.to_date("ts")
    before = events.where(day != F.lit("2024-01-03").cast("date")).withColumn("value", F.when(F.col("event_id") == 4000, -1.0).otherwise(F.col("value")))
    return fingerprint.changed(fingerprint.by_partition(events, day), fingerprint.by_partition(before, day))


# ---------------------------------------------------------------- values and checks


@register(
    """SELECT o_orderkey, o_orderkey::VARCHAR AS key_text, epoch_us(o_orderdate)::VARCHAR AS date_text, o_orderstatus AS status_text,
CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey // 2)::VARCHAR ELSE (o_orderkey // 2)::VARCHAR || '.5' END AS half_text FROM orders"""
)
def row_normalize(spark, sf_dir):
    t = _read(spark, sf_dir, "orders").withColumn("half", (F.col("o_orderkey") / 2).cast("decimal(20,6)"))
    text = lambda c: normalize(F.col(c), t.schema[c].dataType)
    return t.select("o_orderkey", text("o_orderkey").alias("key_text"), text("o_orderdate").alias("date_text"), text("o_orderstatus").alias("status_text"), text("half").alias("half_text"))


@register(f"SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM {TARGET} t) AS target_rows, false AS ok")
def quality_counts(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    n, there = orders.count(), target(orders).count()
    return spark.createDataFrame([(n, there, quality.target_count(n, 0, there).ok)], "source_rows long, target_rows long, ok boolean")


@register("SELECT CAST(epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(max(ts)) AS BIGINT) AS lag_ms, epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(max(ts)) <= 86400000 AS ok FROM events")
def quality_lag(spark, sf_dir):
    mark = cursor.reached(_read(spark, sf_dir, "events"), Incremental(strategy="update_time", column="ts", id_column="event_id"))
    now = datetime(2024, 2, 1)
    up = mark.ts + timedelta(microseconds=500)  # to the nearest millisecond, halves up, as epoch_ms has it
    at = Watermark(up - timedelta(microseconds=up.microsecond % 1000))
    return spark.createDataFrame([(cursor.lag_ms(at, now), quality.watermark_lag(at, 86_400_000, now).ok)], "lag_ms long, ok boolean")


@register(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders),
w AS (SELECT *, least(5000, CAST(ceil(n * 0.1) AS BIGINT)) AS want FROM r)
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' ELSE 'different' END AS problem FROM w
WHERE rn % (n // want) = 0 AND rn // (n // want) < want AND (o_orderkey % 17 = 0 OR o_orderkey % 13 = 0)"""
)
def quality_sample(spark, sf_dir):
    """A stride sample of the source, looked up in the target."""
    orders = _read(spark, sf_dir, "orders")
    return quality.sample_mismatches(quality.stride_sample(orders, ["o_orderkey"], 0.1), target(orders, ghosts_after(orders)), ["o_orderkey"])


@register("SELECT * FROM (VALUES ('WARN', 'NO_OVERLAP'), ('ERROR', 'COLUMN_MISSING'), ('ERROR', 'PK_MISSING'), ('ERROR', 'WATERMARK_REGRESSION')) t(level, code)")
def preflight_findings(spark, sf_dir):
    cfg = from_dict({"source": {"url": sf_dir, "type": "parquet"}, "read": {"table": "orders.parquet", "columns": ["o_orderkey", "nope"], "primaryKey": ["absent"]}, "incremental": {"column": "o_orderdate", "idColumn": "o_orderkey", "overlap": "0s"}})
    found = quality.preflight(cfg, _read(spark, sf_dir, "orders"), Watermark(datetime(2030, 1, 1), 1))
    return spark.createDataFrame([(f.level, f.code) for f in found], "level string, code string")


@register("SELECT * FROM (VALUES ('job', 'incremental', 'SUCCESS', CAST(3 AS BIGINT), '2024-01-02T00:00:00|7')) t(job, mode, status, rows_read, ends)")
def run_history(spark, sf_dir):
    """Reports kept in a store and read back; one of another job, and one that cannot be read, are not among them."""
    store = FileState(spark, f"{stage.folder(spark)}/keelson-queries/{uuid.uuid4().hex}")
    store.add_run(RunReport(job="job", mode="incremental", status="SUCCESS", rows_read=3, end=mark_text(Watermark(datetime(2024, 1, 2), 7))))
    store.add_run(RunReport(job="other"))
    store._write(store._path("runs", "9-broken.json"), "not json")
    return spark.createDataFrame([(r.job, r.mode, r.status, r.rows_read, r.end) for r in store.runs("job")], "job string, mode string, status string, rows_read long, ends string")


# ---------------------------------------------------------------- sinks


@register("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS value FROM nation")
def sink_json(spark, sf_dir):
    """The lines of the files that the file sink wrote."""
    cfg = from_dict({"source": {"url": sf_dir}, "read": {"table": "nation"}, "target": {"type": "file", "path": f"{stage.folder(spark)}/keelson-queries/{uuid.uuid4().hex}"}})
    sinks.open_sink(spark, cfg).write(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return spark.read.text(cfg.target.path)


@register("SELECT n_regionkey::VARCHAR || '|' || n_nationkey::VARCHAR AS key, to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey, '_op': CASE WHEN n_nationkey < 3 THEN 'd' END})::VARCHAR AS value FROM nation")
def sink_kafka_kv(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.kafka_rows(nation.withColumn(OP, F.when(F.col("n_nationkey") < 3, "d")), ["n_regionkey", "n_nationkey"])


@register("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, '__DORIS_DELETE_SIGN__': CASE WHEN n_nationkey < 3 THEN '1' ELSE '0' END})::VARCHAR AS value FROM nation")
def sink_doris_payload(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sinks.doris_rows(nation.withColumn(OP, F.when(F.col("n_nationkey") < 3, "d")))


@register("SELECT * FROM (VALUES (0, '[-inf,3)'), (1, '[3,5)'), (2, '[5,inf)')) t(shard, label)")
def plan_shards(spark, sf_dir):
    ids = spark.range(1, 7)
    plan = splits.plan(ids, Splits(column="id").column, 3)
    return spark.createDataFrame(list(enumerate(s.label for s in plan.shards)), "shard int, label string")
