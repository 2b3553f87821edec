"""Registered queries of operators that write, keep state or make SQL: each runs its operator whole and returns what came of it."""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import cli, config
from keelson.functions.values import OP
from keelson.operators import diff, quality, splits
from keelson.operators.cursor import Watermark
from keelson.plans.catalogue import TARGET, _read, ghosts_after, register, target
from keelson.plans.runner import Job, PlanChanged, throttle_seconds, with_retry
from keelson.sources import dialects, scan, sinks, stage
from keelson.state import JdbcState, RunReport, StateStore, mark_of, mark_text, open_state
from keelson.state import register as register_state


def _fresh(spark) -> str:
    return f"{stage.folder(spark)}/keelson-queries/{uuid.uuid4().hex}"


def _job(spark, sf_dir: str, at: str = "", **more: object) -> Job:
    """A job over a table of sf_dir that merges into a snapshot table; sections of ``more`` go on top."""
    at = at or _fresh(spark)
    values = {
        "name": "job",
        "source": {"type": "parquet", "url": sf_dir},
        "read": {"table": "orders.parquet", "primaryKey": ["o_orderkey"]},
        "incremental": {"column": "o_orderdate", "idColumn": "o_orderkey", "overlap": "0s"},
        "splits": {"column": "o_orderkey"},
        "target": {"type": "parquet", "path": f"{at}/out", "primaryKey": ["o_orderkey"]},
        "state": {"path": f"{at}/state"},
        "runtime": {"retryBackoffMs": 1, "retryJitterMs": 0},
    }
    for k, v in more.items():
        values[k] = values.get(k, {}) | v if isinstance(v, dict) else v
    return Job(spark, config.from_dict(values).validate())


def _ok(report: RunReport) -> RunReport:
    if report.status == "FAILED":
        raise RuntimeError(report.message)
    return report


def _derby(spark, statement: str = "") -> str:
    url = f"jdbc:derby:memory:k{uuid.uuid4().hex};create=true"
    if statement:
        c = spark._jvm.java.sql.DriverManager.getConnection(url)
        c.createStatement().executeUpdate(statement)
        c.close()
    return url


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# ---------------------------------------------------------------- scans


@register(f"SELECT {_ORDER} FROM orders")
def full_snapshot(spark, sf_dir):
    """All shards, some at a time, into a snapshot table."""
    job = _job(spark, sf_dir, splits={"numPartitions": 6, "mode": "parallel"})
    _ok(job.run("full"))
    return job.sink.read()


@register(f"SELECT {_ORDER} FROM orders")
def full_resumed(spark, sf_dir):
    """A full run that was cut off after two shards, and the one after it."""
    job = _job(spark, sf_dir, splits={"numPartitions": 4})
    for i in (0, 2):
        job.run_shard(i)
    if _ok(job.run("full")).shards_skipped != 2:
        raise RuntimeError("marked shards were read again")
    return job.sink.read()


@register("WITH b AS (SELECT min(o_orderkey) AS lo, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0) AS BIGINT) AS step FROM orders) SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_orderkey >= lo + step AND o_orderkey < lo + 3 * step AND o_orderstatus = 'F'")
def shard_scan(spark, sf_dir):
    job = _job(spark, sf_dir, read={"columns": ["o_orderkey", "o_totalprice"], "filter": "o_orderstatus = 'F'"}, splits={"numPartitions": 4})
    shards = splits.plan(_read(spark, sf_dir, "orders"), "o_orderkey", 4).shards
    return scan.read(spark, job.cfg, shards=list(shards[1:3]))


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark, sf_dir):
    return scan.read(spark, _job(spark, sf_dir, read={"table": "nation.parquet"}).cfg).select("n_nationkey", "n_name", "n_regionkey")


@register("SELECT c_custkey, c_name FROM customer")
def target_read(spark, sf_dir):
    sink = _job(spark, sf_dir, target={"primaryKey": ["c_custkey"]}).sink
    if sink.read() is not None:
        raise RuntimeError("a table that was never written")
    sink.write(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return sink.read()


@register("SELECT * FROM (VALUES ('console', false), ('doris', false), ('file', false), ('jdbc', true), ('kafka', false), ('paimon', true), ('parquet', true), ('starrocks', false), ('table', true)) t(type, readable)")
def readability_gate(spark, sf_dir):
    own = ("console", "doris", "file", "jdbc", "kafka", "paimon", "parquet", "starrocks", "table")
    return spark.createDataFrame([(k, sinks._TYPES[k].readable) for k in own], "type string, readable boolean")


@register("SELECT * FROM (VALUES ('a'), ('c')) t(indexed)")
def index_discovery(spark, sf_dir):
    """Leading columns of a database table's indexes."""
    url = _derby(spark, "CREATE TABLE IX (A BIGINT NOT NULL PRIMARY KEY, B INT, C INT)")
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate("CREATE INDEX IXC ON IX (C, B)")
    c.close()
    found = scan.indexed_columns(spark, _job(spark, sf_dir, source={"type": "derby", "url": url}, read={"table": "IX"}).cfg)
    return spark.createDataFrame([(x,) for x in sorted(found)], "indexed string")


@register("SELECT * FROM (VALUES ('mysql', 'useCursorFetch=true,rewriteBatchedStatements=true'), ('postgres', 'defaultRowFetchSize=5000'), ('oracle', 'defaultRowPrefetch=5000'), ('h2', '')) t(type, options)")
def connection_defaults(spark, sf_dir):
    own = [(k, ",".join(f"{a}={b}" for a, b in dialects.by_name(k).options)) for k in ("mysql", "postgres", "oracle", "h2")]
    return spark.createDataFrame(own, "type string, options string")


@register("SELECT * FROM (VALUES ('parallel', 2), ('sequential', 1)) t(mode, at_once)")
def bounded_pool(spark, sf_dir):
    """Connections that a run opens at a time: the partitions of one of its reads."""
    url = _derby(spark, "CREATE TABLE P (ID BIGINT)")
    out = []
    for mode in ("parallel", "sequential"):
        job = _job(spark, sf_dir, source={"type": "derby", "url": url, "poolMax": 2}, read={"table": "P"}, splits={"column": "ID", "numPartitions": 5, "strategy": "mod", "mode": mode})
        shards = job.plan()[0].shards[: job.cfg.queries_at_once]
        out.append((mode, scan.read(spark, job.cfg, shards=list(shards)).rdd.getNumPartitions()))
    return spark.createDataFrame(out, "mode string, at_once int")


# ---------------------------------------------------------------- SQL of databases

_NAMES = ("standard", "mysql", "postgres", "oracle", "sqlserver", "h2")


def _said(spark, f) -> DataFrame:
    return spark.createDataFrame([(k, f(dialects.by_name(k))) for k in _NAMES], "dialect string, said string")


def _values(*said: str) -> str:
    rows = ", ".join(f"('{k}', '{s.replace(chr(39), 2 * chr(39))}')" for k, s in zip(_NAMES, said, strict=True))
    return f"SELECT * FROM (VALUES {rows}) t(dialect, said)"


@register(_values('"s"."a b"', "`s`.`a b`", '"s"."a b"', '"s"."a b"', "[s].[a b]", "s.a b"))
def dialect_quote(spark, sf_dir):
    return _said(spark, lambda d: d.quote(d.quote("s.a b")))


@register(_values('SELECT "a" FROM t LIMIT 3', "SELECT `a` FROM t LIMIT 3", 'SELECT "a" FROM t LIMIT 3', 'SELECT "a" FROM t FETCH FIRST 3 ROWS ONLY', "SELECT TOP (3) [a] FROM t", "SELECT a FROM t LIMIT 3"))
def dialect_limit(spark, sf_dir):
    return _said(spark, lambda d: d.select(["a"], "t", limit=3))


@register(
    _values(
        "none",
        "INSERT INTO t (`k`, `v`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)",
        'INSERT INTO t ("k", "v") VALUES (?, ?) ON CONFLICT ("k") DO UPDATE SET "v" = EXCLUDED."v"',
        'MERGE INTO t t USING (SELECT ? AS "k", ? AS "v" FROM dual) s ON (t."k" = s."k") WHEN MATCHED THEN UPDATE SET t."v" = s."v" WHEN NOT MATCHED THEN INSERT ("k", "v") VALUES (s."k", s."v")',
        "MERGE INTO t t USING (SELECT ? AS [k], ? AS [v]) s ON (t.[k] = s.[k]) WHEN MATCHED THEN UPDATE SET t.[v] = s.[v] WHEN NOT MATCHED THEN INSERT ([k], [v]) VALUES (s.[k], s.[v]);",
        "MERGE INTO t (k, v) KEY (k) VALUES (?, ?)",
    )
)
def dialect_upsert(spark, sf_dir):
    def said(d: dialects.Dialect) -> str:
        try:
            return d.upsert("t", ["k", "v"], ["k"])
        except ValueError:
            return "none"

    return _said(spark, said)


@register(_values('INSERT INTO t ("k", "v") VALUES (?, ?)', "INSERT INTO t (`k`, `v`) VALUES (?, ?)", 'INSERT INTO t ("k", "v") VALUES (?, ?)', 'INSERT INTO t ("k", "v") VALUES (?, ?)', "INSERT INTO t ([k], [v]) VALUES (?, ?)", "INSERT INTO t (k, v) VALUES (?, ?)"))
def dialect_insert(spark, sf_dir):
    return _said(spark, lambda d: d.insert("t", ["k", "v"]))


@register(_values('DELETE FROM t WHERE "a" = ? AND "b" = ?', "DELETE FROM t WHERE `a` = ? AND `b` = ?", 'DELETE FROM t WHERE "a" = ? AND "b" = ?', 'DELETE FROM t WHERE "a" = ? AND "b" = ?', "DELETE FROM t WHERE [a] = ? AND [b] = ?", "DELETE FROM t WHERE a = ? AND b = ?"))
def dialect_delete(spark, sf_dir):
    return _said(spark, lambda d: d.delete("t", ["a", "b"]))


@register(_values('MOD((MOD("c", 4) + 4), 4) = 1', "MOD((MOD(`c`, 4) + 4), 4) = 1", '((("c" % 4) + 4) % 4) = 1', 'MOD((MOD("c", 4) + 4), 4) = 1', "((([c] % 4) + 4) % 4) = 1", "MOD((MOD(c, 4) + 4), 4) = 1"))
def dialect_mod(spark, sf_dir):
    return _said(spark, lambda d: d.shard(splits.Shard("mod", "c", n=4, remainder=1)))


@register(_values("none", "MOD(CRC32(`c`), 4) = 1", 'MOD(ABS(hashtext(CAST("c" AS text))::bigint), 4) = 1', 'MOD(ORA_HASH("c"), 4) = 1', "(ABS(CAST(CHECKSUM([c]) AS bigint)) % 4) = 1", "none"))
def dialect_hash(spark, sf_dir):
    def said(d: dialects.Dialect) -> str:
        try:
            return d.shard(splits.Shard("hash", "c", n=4, remainder=1))
        except ValueError:
            return "none"

    return _said(spark, said)


@register(_values('ALTER TABLE t ADD COLUMN "c" INT', "ALTER TABLE t ADD COLUMN `c` INT", 'ALTER TABLE t ADD COLUMN "c" INT', 'ALTER TABLE t ADD ("c" INT)', "ALTER TABLE t ADD [c] INT", "ALTER TABLE t ADD COLUMN c INT"))
def dialect_add_column(spark, sf_dir):
    return _said(spark, lambda d: d.add("t", "c", "INT"))


_STAMP = "2024-01-02 03:04:05.000006"


@register(_values(f"'{_STAMP}'", f"'{_STAMP}'", f"'{_STAMP}'", f"TIMESTAMP '{_STAMP}'", f"'{_STAMP}'", f"'{_STAMP}'"))
def dialect_timestamp(spark, sf_dir):
    return _said(spark, lambda d: d.timestamp(datetime(2024, 1, 2, 3, 4, 5, 6)))


@register("SELECT * FROM (VALUES ('mine', '`a`'), ('imported', '[a]')) t(type, said)")
def dialect_spi(spark, sf_dir):
    """Dialects under a new name, and by the name of an object."""
    dialects.register("mine", dialects.MYSQL)
    return spark.createDataFrame([("mine", dialects.by_url("jdbc:mine://h").quote("a")), ("imported", dialects.by_name("keelson.sources.dialects:SQLSERVER").quote("a"))], "type string, said string")


# ---------------------------------------------------------------- predicates and plans


@register('SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_Name" FROM nation')
def label_normalise(spark, sf_dir):
    """Rows under the names as a database table spells them."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sinks.JdbcSink._named(None, nation, nation.toDF("N_NATIONKEY", "N_Name"))


@register("SELECT count(*) AS n FROM lineitem")
def full_scan_shard(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").where(splits.Shard().predicate()).agg(F.count(F.lit(1)).alias("n"))


def _plan(spark, p: splits.Plan) -> DataFrame:
    return spark.createDataFrame([(p.mode, s.label, len(p.warnings)) for s in p.shards], "mode string, label string, warnings int")


@register("SELECT * FROM (VALUES ('none', 'all', 0)) t(mode, label, warnings)")
def plan_single(spark, sf_dir):
    return _plan(spark, splits.plan(_read(spark, sf_dir, "orders"), "o_orderkey", 1))


@register("SELECT * FROM (VALUES ('hash', 'hash(mod 3)=0', 1), ('hash', 'hash(mod 3)=1', 1), ('hash', 'hash(mod 3)=2', 1)) t(mode, label, warnings)")
def plan_text_range(spark, sf_dir):
    return _plan(spark, splits.plan(_read(spark, sf_dir, "orders"), "o_orderpriority", 3, "range"))


@register("SELECT * FROM (VALUES ('none', 'all', 1)) t(mode, label, warnings)")
def plan_no_hash(spark, sf_dir):
    return _plan(spark, splits.plan(_read(spark, sf_dir, "orders"), "o_orderpriority", 3, "auto", can_hash=False))


@register("SELECT * FROM (VALUES ('range', '[-inf,inf)', 0)) t(mode, label, warnings)")
def plan_empty(spark, sf_dir):
    return _plan(spark, splits.plan(_read(spark, sf_dir, "orders").where("o_orderkey < -5"), "o_orderkey", 4))


@register("SELECT * FROM (VALUES ('again', true), ('columns', false), ('filter', false), ('parts', false), ('source', false)) t(change, same)")
def plan_identity(spark, sf_dir):
    """A plan's id changes with whatever changes the rows of its shards."""
    orders = _read(spark, sf_dir, "orders")
    p, q = splits.plan(orders, "o_orderkey", 4), splits.plan(orders, "o_orderkey", 5)
    own = splits.plan_id("s", ["a"], "f", "o_orderkey", p)
    others = {"again": ("s", ["a"], "f", p), "columns": ("s", ["b"], "f", p), "filter": ("s", ["a"], "g", p), "parts": ("s", ["a"], "f", q), "source": ("t", ["a"], "f", p)}
    return spark.createDataFrame([(k, splits.plan_id(s, c, f, "o_orderkey", x) == own) for k, (s, c, f, x) in others.items()], "change string, same boolean")


@register("WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 3.0) AS BIGINT) AS step FROM orders) SELECT CAST(0 AS BIGINT) AS shard, count(*) FILTER (WHERE o_orderkey < lo + step) AS n FROM orders, b UNION ALL SELECT 2, count(*) FILTER (WHERE o_orderkey >= lo + 2 * step) FROM orders, b UNION ALL SELECT 9, 0")
def plan_exec_shard(spark, sf_dir):
    """Shards run one by one, by number, for an outside scheduler; 9: a stale plan's id is refused."""
    job = _job(spark, sf_dir, splits={"numPartitions": 3})
    plan_id = job.plan()[1]
    out = [(i, job.run_shard(i, plan_id)["rows"]) for i in (0, 2)]
    with contextlib.suppress(PlanChanged):
        out.append((9, job.run_shard(0, "stale")["rows"] + 1))
    if len(out) == 2:
        out.append((9, 0))
    return spark.createDataFrame(out, "shard long, n long")


# ---------------------------------------------------------------- cursors and state


@register("SELECT * FROM (VALUES ('', ''), ('|7', '|7'), ('2024-01-02T03:04:05.000006|', '2024-01-02T03:04:05.000006|'), ('2024-01-02T00:00:00|-5', '2024-01-02T00:00:00|-5')) t(said, back)")
def cursor_codec(spark, sf_dir):
    marks = [Watermark(), Watermark(None, 7), Watermark(datetime(2024, 1, 2, 3, 4, 5, 6)), Watermark(datetime(2024, 1, 2), -5)]
    return spark.createDataFrame([(mark_text(m), mark_text(mark_of(mark_text(m)))) for m in marks], "said string, back string")


@register("SELECT 'full' AS run, '' AS starts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS ends, count(*) AS n FROM events UNION ALL SELECT 'incremental', strftime(max(ts), '%Y-%m-%dT%H:%M:%S'), strftime(max(ts), '%Y-%m-%dT%H:%M:%S'), count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) FROM events")
def cursor_advance(spark, sf_dir):
    """A full run begins without a cursor and leaves one; the next increment begins there, less the lookback."""
    job = _job(spark, sf_dir, read={"table": "events.parquet", "primaryKey": ["event_id"]}, incremental={"strategy": "update_time", "column": "ts", "idColumn": "event_id", "overlap": "1d"}, target={"primaryKey": ["event_id"]}, splits={"column": "event_id"})
    out = []
    for mode in ("full", "incremental"):
        r = _ok(job.run(mode))
        if mark_text(job.state.watermark("job")) != r.end:
            raise RuntimeError("the cursor is not what the report says")
        out.append((mode, r.start.split("|")[0][:19], r.end.split("|")[0][:19], r.rows_read))
    return spark.createDataFrame(out, "run string, starts string, ends string, n long")


@register("SELECT * FROM (VALUES ('diff', '2024-01-01T00:00:00|5', ''), ('reset', '', '')) t(after, mark, shards)")
def cursor_kept_and_reset(spark, sf_dir):
    """A diff leaves the cursor; a reset takes it, and the marks of shards."""
    job = _job(spark, sf_dir, read={"table": "nation.parquet", "primaryKey": ["n_nationkey"]}, target={"primaryKey": ["n_nationkey"]}, deleteDetect={"mode": "pk_diff"})
    job.state.save_watermark("job", Watermark(datetime(2024, 1, 1), 5))
    _ok(job.run("diff"))
    out = [("diff", mark_text(job.state.watermark("job")), "")]
    job.state.mark_done("job", "p", 3, Watermark())
    job.state.reset("job")
    return spark.createDataFrame([*out, ("reset", mark_text(job.state.watermark("job")), ",".join(map(str, job.state.done("job", "p"))))], "after string, mark string, shards string")


def _kept(spark, store: StateStore) -> DataFrame:
    store.put("j", "k", "first")
    store.put("j", "k", "second")
    store.put("j", "gone", "x")
    store.put("j", "gone", None)
    store.save_watermark("j", Watermark(datetime(2024, 1, 2), 7))
    store.mark_done("j", "p", 1, Watermark(None, 4))
    store.mark_done("j", "other", 2, Watermark(None, 9))
    store.clear_progress("j", keep_plan="p")
    for i in range(3):
        store.add_run(RunReport(run_id=f"r{i}", job="j" if i else "x", started_at=f"2024-01-0{i + 1}", message="m" * 20_000))
    out = [("value", store.get("j", "k")), ("absent", str(store.get("j", "gone"))), ("cursor", mark_text(store.watermark("j"))), ("shards", json.dumps({k: mark_text(v) for k, v in store.done("j", "p").items()})), ("other plan", str(len(store.done("j", "other")))), ("runs", " ".join(r.run_id for r in store.runs("j"))), ("last", store.runs(limit=1)[0].run_id), ("message", str(len(store.runs("j")[0].message)))]
    return spark.createDataFrame(out, "what string, said string")


_KEPT = "SELECT * FROM (VALUES ('value', 'second'), ('absent', 'None'), ('cursor', '2024-01-02T00:00:00|7'), ('shards', '{\"1\": \"|4\"}'), ('other plan', '0'), ('runs', 'r2 r1'), ('last', 'r2'), ('message', '20000')) t(what, said)"


@register(_KEPT)
def state_file(spark, sf_dir):
    """Values, cursors, marks of shards and reports in files."""
    return _kept(spark, open_state(spark, config.State(path=f"{_fresh(spark)}/state")))


@register(_KEPT)
def state_jdbc(spark, sf_dir):
    """The same in a database."""
    return _kept(spark, JdbcState(spark, _derby(spark)))


@register("SELECT * FROM (VALUES ('made for p')) t(said)")
def state_spi(spark, sf_dir):
    register_state("query_store", lambda s, c: f"made for {c.path}")
    return spark.createDataFrame([(open_state(spark, config.State(type="query_store", path="p")),)], "said string")


@register("SELECT 'full' AS mode, 'SUCCESS' AS status, count(*) AS rows_read, count(*) AS rows_written, true AS timed FROM nation UNION ALL SELECT 'diff', 'SUCCESS', count(*), 0, true FROM nation")
def run_metrics(spark, sf_dir):
    """The reports of two runs, read back from the store, newest last."""
    job = _job(spark, sf_dir, read={"table": "nation.parquet", "primaryKey": ["n_nationkey"]}, target={"primaryKey": ["n_nationkey"]}, deleteDetect={"mode": "pk_diff"})
    for mode in ("full", "diff"):
        _ok(job.run(mode))
    return spark.createDataFrame([(r.mode, r.status, r.rows_read, r.rows_written, r.duration_ms > 0 and r.rows_per_sec > 0) for r in job.state.runs("job")], "mode string, status string, rows_read long, rows_written long, timed boolean")


@register("SELECT * FROM (VALUES ('flaky', 'done', 2), ('wrong', 'ValueError', 0), ('down', 'OSError', 2)) t(work, outcome, waits)")
def retry(spark, sf_dir):
    def run(name: str, fails: int, error: type) -> tuple[str, str, int]:
        tries, waits = [], []

        def work() -> str:
            tries.append(1)
            if len(tries) <= fails:
                raise error("no")
            return "done"

        try:
            return name, with_retry(config.JobConfig(), work, sleep=waits.append), len(waits)
        except Exception as e:
            return name, type(e).__name__, len(waits)

    return spark.createDataFrame([run("flaky", 2, OSError), run("wrong", 9, ValueError), run("down", 9, OSError)], "work string, outcome string, waits int")


@register("SELECT * FROM (VALUES ('asked', CAST(2.0 AS DOUBLE)), ('behind', CAST(0.0 AS DOUBLE)), ('held back', CAST(1.0 AS DOUBLE)), ('off', CAST(0.0 AS DOUBLE))) t(what, seconds)")
def rate_limit(spark, sf_dir):
    """Waits of the limiter, and (held back) that a run over nation's 25 rows at 10 a second waits for a second or more while it reads."""
    job = _job(spark, sf_dir, read={"table": "nation.parquet", "primaryKey": ["n_nationkey"]}, target={"primaryKey": ["n_nationkey"]}, runtime={"maxRowsPerSec": 10})
    held = _ok(job.run("full")).throttled_ms >= 1000
    out = [("asked", throttle_seconds(5000, 0.5, 2000)), ("behind", throttle_seconds(10, 5.0, 2000)), ("held back", float(held)), ("off", throttle_seconds(5, 0.0, 0))]
    return spark.createDataFrame(out, "what string, seconds double")


# ---------------------------------------------------------------- diffs


@register("SELECT 1 AS pass, 'SUCCESS' AS status, count(*) AS rows_read, '' AS said FROM nation UNION ALL SELECT 2, 'SUCCESS', 0, 'UNCHANGED' FROM nation HAVING count(*) > 0 UNION ALL SELECT 3, 'SUCCESS', count(*), '' FROM nation WHERE n_regionkey = 1")
def fingerprint_gate(spark, sf_dir):
    """The first diff compares all, the second nothing; after one row of the target drifted, the third its partition."""
    job = _job(spark, sf_dir, read={"table": "nation.parquet", "primaryKey": ["n_nationkey"]}, target={"primaryKey": ["n_nationkey"]}, deleteDetect={"mode": "fingerprint", "fingerprintColumn": "n_regionkey"})
    out = []
    for turn in (1, 2, 3):
        if turn == 3:
            job.sink.write(_read(spark, sf_dir, "nation").where("n_nationkey = (SELECT min(n_nationkey) FROM parquet.`{}` WHERE n_regionkey = 1)".format(f"{sf_dir}/nation.parquet")).withColumn("n_name", F.lit("drifted")))
        r = _ok(job.run("diff"))
        out.append((turn, r.status, r.rows_read, ",".join(f["code"] for f in r.findings)))
    return spark.createDataFrame(out, "pass int, status string, rows_read long, said string")


@register("SELECT * FROM (VALUES ('file', 'FAILED'), ('console', 'FAILED'), ('parquet', 'SUCCESS')) t(target, status)")
def write_only_guard(spark, sf_dir):
    """A target that cannot be read back is never taken for an empty one."""
    read = {"table": "region.parquet", "primaryKey": ["r_regionkey"]}
    out = []
    for kind in ("file", "console", "parquet"):
        at = _fresh(spark)
        out.append((kind, _job(spark, sf_dir, at, read=read, target={"type": kind, "primaryKey": ["r_regionkey"]}, deleteDetect={"mode": "pk_diff"}).run("diff").status))
    return spark.createDataFrame(out, "target string, status string")


@register("SELECT * FROM (VALUES ('SUCCESS', 'NO_DELETE_DETECT', CAST(0 AS BIGINT))) t(status, code, written)")
def delete_none(spark, sf_dir):
    r = _job(spark, sf_dir).run("diff")
    return spark.createDataFrame([(r.status, r.findings[0]["code"], r.rows_written)], "status string, code string, written long")


# ---------------------------------------------------------------- sinks


@register("SELECT n_nationkey::VARCHAR || ',' || n_name || ',' || n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT 'n_nationkey,n_name,n_regionkey'")
def sink_csv(spark, sf_dir):
    return _lines(spark, sf_dir, "csv")


@register("SELECT n_nationkey::VARCHAR || chr(9) || n_name || chr(9) || n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'n_regionkey'")
def sink_tsv(spark, sf_dir):
    return _lines(spark, sf_dir, "tsv")


@register("SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey, 'extra': NULL})::VARCHAR AS value FROM nation")
def sink_json_file(spark, sf_dir):
    return _lines(spark, sf_dir, "jsonl", extra=F.lit(None).cast("string"))


def _lines(spark, sf_dir: str, kind: str, **more: object) -> DataFrame:
    """What the file sink wrote, line by line."""
    sink = _job(spark, sf_dir, target={"type": "file", "format": kind}).sink
    sink.write(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").withColumns(more).coalesce(1))
    return spark.read.text(sink.target.path)


def _in_database(spark, sf_dir: str, mode: str = "merge") -> sinks.JdbcSink:
    url = _derby(spark, 'CREATE TABLE N ("n_nationkey" INT NOT NULL PRIMARY KEY, "n_name" VARCHAR(30))' if mode == "merge" else 'CREATE TABLE N ("n_nationkey" INT, "n_name" VARCHAR(30))')
    sink = _job(spark, sf_dir, target={"type": "jdbc", "url": url, "table": "N", "writeMode": mode, "primaryKey": ["n_nationkey"]}).sink
    sink.write(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return sink


@register("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new ' || n_name ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'late' FROM nation WHERE n_nationkey = 3")
def sink_jdbc_merge(spark, sf_dir):
    """Updates and inserts merged into a database table; of two changes of a key the last."""
    sink, nation = _in_database(spark, sf_dir), _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for _ in range(2):  # a replay changes nothing
        sink.write(nation.where("n_nationkey < 5").withColumn("n_name", F.concat(F.lit("new "), "n_name")).union(nation.where("n_nationkey = 3").selectExpr("n_nationkey + 100", "'late'")))
    return sink.read()


@register("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def sink_jdbc_append(spark, sf_dir):
    sink = _in_database(spark, sf_dir, "append")
    sink.write(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return sink.read()


@register("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 2 THEN CAST(7 AS BIGINT) END AS extra FROM nation")
def sink_jdbc_evolve(spark, sf_dir):
    """A column that only the changes have is added to the table."""
    sink = _in_database(spark, sf_dir)
    sink.write(_read(spark, sf_dir, "nation").where("n_nationkey = 2").select("n_nationkey", "n_name", F.lit(7).cast("long").alias("extra")))
    return sink.read()


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0")
def sink_jdbc_delete(spark, sf_dir):
    sink = _in_database(spark, sf_dir)
    sink.write(_read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", "n_name", F.lit("d").alias(OP)))
    return sink.read()


@register("SELECT count(*) || ' rows' AS said FROM region")
def sink_console(spark, sf_dir):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        _job(spark, sf_dir, target={"type": "console"}).sink.write(_read(spark, sf_dir, "region"))
    return spark.createDataFrame([(told.getvalue().splitlines()[-1],)], "said string")


@register("SELECT * FROM orders UNION ALL SELECT * FROM " + TARGET + " t WHERE o_orderkey >= 1000000 AND o_orderkey % 3 <> 0")
def sink_snapshot_merge(spark, sf_dir):
    """A snapshot table after two writes of changes on top of it."""
    orders = _read(spark, sf_dir, "orders")
    sink = _job(spark, sf_dir).sink
    sink.write(target(orders))
    sink.write(diff.diff(orders, sink.read(), ["o_orderkey"]).where(F.col(OP) != "d"))
    sink.write(sink.read().where("o_orderkey >= 1000000 AND o_orderkey % 3 = 0").withColumn(OP, F.lit("d")))
    return sink.read()


class ViewSink(sinks.Sink):
    """A target that a user might write: the rows as a view."""

    readable = True

    def write(self, rows: DataFrame) -> None:
        rows.createOrReplaceTempView(self.target.table)

    def read(self) -> DataFrame | None:
        return self.spark.table(self.target.table)


@register("SELECT r_regionkey, r_name FROM region")
def sink_spi(spark, sf_dir):
    """A target type by the name of its class."""
    sink = _job(spark, sf_dir, target={"type": f"{__name__}:ViewSink", "table": "keelson_view_sink"}).sink
    sink.write(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return sink.read()


# ---------------------------------------------------------------- checks


_ROWS = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)"


@register(f"SELECT o_orderkey, o_totalprice FROM {_ROWS} t WHERE rn % (n // least(5000, CAST(ceil(n * 0.02) AS BIGINT))) = 0 AND rn // (n // least(5000, CAST(ceil(n * 0.02) AS BIGINT))) < least(5000, CAST(ceil(n * 0.02) AS BIGINT))")
def quality_stride(spark, sf_dir):
    """Rows at even strides in key order, over all rows."""
    return quality.stride_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.02)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY ('0x' || substr(md5('3|' || o_orderkey::VARCHAR), 1, 15))::BIGINT, o_orderkey LIMIT (SELECT least(5000, CAST(ceil(count(*) * 0.02) AS BIGINT)) FROM orders)")
def quality_random(spark, sf_dir):
    """A random sample of all rows, the same for one seed."""
    return quality.random_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.02, seed=3)


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'missing' ELSE 'different' END AS problem FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 13 = 0")
def quality_mismatches(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return quality.sample_mismatches(orders, target(orders, ghosts_after(orders)), ["o_orderkey"])


@register("SELECT 'row_count' AS name, true AS ok UNION ALL SELECT 'target_count', true UNION ALL SELECT 'sample_hash', true")
def quality_run(spark, sf_dir):
    """The checks of a full run."""
    r = _ok(_job(spark, sf_dir, quality={"sampleHashCheck": 0.01}).run("full"))
    return spark.createDataFrame([(c["name"], c["ok"]) for c in r.checks], "name string, ok boolean")


@register("SELECT * FROM (VALUES ('none', 'SUCCESS'), ('bad', 'QUALITY_WARN'), ('strict', 'QUALITY_FAILED'), ('negative', 'QUALITY_WARN')) t(checks, status)")
def quality_verdict(spark, sf_dir):
    bad = [quality.Check("x", False)]
    return spark.createDataFrame([("none", quality.verdict([None], True)), ("bad", quality.verdict(bad, False)), ("strict", quality.verdict(bad, True)), ("negative", quality.verdict([quality.row_count(-1, 0), quality.row_count(3, 3)], False))], "checks string, status string")


@register("SELECT * FROM (VALUES ('lenient', 'WARN NO_INDEX'), ('strict', 'ERROR NO_INDEX'), ('indexed', '')) t(case_, said)")
def preflight_index(spark, sf_dir):
    orders, out = _read(spark, sf_dir, "orders"), []
    for case, strict, indexed in (("lenient", False, {"o_orderkey"}), ("strict", True, {"o_orderkey"}), ("indexed", True, {"o_orderkey", "o_orderdate"})):
        cfg = _job(spark, sf_dir, mode="incremental", incremental={"overlap": "5m"}, quality={"failOnMissingIndex": strict}).cfg
        out.append((case, " ".join(f"{f.level} {f.code}" for f in quality.preflight(cfg, orders, Watermark(), indexed))))
    return spark.createDataFrame(out, "case_ string, said string")


@register("SELECT * FROM (VALUES ('FAILED', CAST(0 AS BIGINT), true)) t(status, written, untouched)")
def preflight_aborts(spark, sf_dir):
    """An error found before a run ends it before anything is written."""
    job = _job(spark, sf_dir, read={"columns": ["o_orderkey", "nope"]}, quality={"preflightEnabled": True})
    r = job.run("full")
    return spark.createDataFrame([(r.status, r.rows_written, job.sink.read() is None)], "status string, written long, untouched boolean")


# ---------------------------------------------------------------- programs


@register("SELECT * FROM (VALUES ('run full', 0, '\"status\": \"SUCCESS\"'), ('plan', 0, '\"mode\": \"range\"'), ('check', 0, 'SUCCESS'), ('runs', 0, 'full SUCCESS'), ('reset', 0, 'reset'), ('state', 0, 'empty'), ('run sideways', 2, '')) t(command, code, said)")
def command_line(spark, sf_dir):
    return spark.createDataFrame(_commands(spark, sf_dir), "command string, code int, said string")


def _commands(spark, sf_dir: str) -> list[tuple[str, int, str]]:
    import os
    import tempfile

    at, out = _fresh(spark), []
    values = {"name": "cli", "source": {"type": "parquet", "url": sf_dir, "read": {"table": "nation.parquet", "primaryKey": ["n_nationkey"], "incremental": {"strategy": "id", "idColumn": "n_nationkey"}, "splits": {"column": "n_nationkey", "numPartitions": 2}}}, "target": {"type": "parquet", "path": f"{at}/out", "primaryKey": ["n_nationkey"]}, "state": {"path": f"{at}/state"}}
    with tempfile.TemporaryDirectory() as folder:  # the job file is read by this program alone
        path = os.path.join(folder, "job.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(values, f)
        for command, looked_for in (("run full", '"status": "SUCCESS"'), ("plan", '"mode": "range"'), ("check", "SUCCESS"), ("runs", "full SUCCESS"), ("reset", "reset"), ("state", "empty"), ("run sideways", "")):
            told = io.StringIO()
            with contextlib.redirect_stdout(told), contextlib.redirect_stderr(io.StringIO()):
                code = cli.main([*command.split(), "-c", path], spark)
            out.append((command, code, looked_for if looked_for in told.getvalue() else told.getvalue()))
    return out


@register("SELECT 'incremental' AS mode, 'SUCCESS' AS status, count(*) AS rows_read FROM nation")
def scheduler_task(spark, sf_dir):
    """What a scheduler's task runs: a job's text, and a mode that falls back to incremental."""
    at = _fresh(spark)
    text = json.dumps({"name": "task", "source": {"type": "parquet", "url": sf_dir}, "read": {"table": "nation.parquet", "primaryKey": ["n_nationkey"]}, "incremental": {"strategy": "id", "idColumn": "n_nationkey"}, "target": {"type": "parquet", "path": f"{at}/out", "primaryKey": ["n_nationkey"]}, "state": {"path": f"{at}/state"}})
    r = cli.run_task({"configYaml": text, "mode": "anything"}, spark)
    return spark.createDataFrame([(r["mode"], r["status"], r["rows_read"])], "mode string, status string, rows_read long")
