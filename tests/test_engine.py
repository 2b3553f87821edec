"""Operators of the synchronisation engine, with the cases its design decides on purpose."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson import config
from keelson.functions.durations import parse_duration
from keelson.functions.values import OP, normalize, row_hash, same
from keelson.operators import cursor, diff, fingerprint, merge, quality, splits
from keelson.operators.cursor import Watermark
from keelson.sources import dialects, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- configuration


@pytest.mark.parametrize(("text", "seconds"), [("", 0), (None, 0), ("PT5M", 300), ("P1DT2H", 93600), ("250ms", 0.25), ("10s", 10), ("2 h", 7200), ("3d", 259200), ("PT1.5S", 1.5)])
def test_durations(text, seconds):
    assert parse_duration(text) == timedelta(seconds=seconds)


@pytest.mark.parametrize("text", ["5", "PT", "five", "P"])
def test_durations_that_cannot_be_read(text):
    with pytest.raises(ValueError, match="duration"):
        parse_duration(text)


def base(**more):
    return {"source": {"url": "x"}, "read": {"table": "t"}, "target": {"type": "console"}} | more


def test_config_reads_yaml_and_json_and_ignores_unknown_keys():
    cfg = config.loads("name: j\nmode: FULL\nsource: {url: 'jdbc:x', poolMax: 3, nope: 1}\nread: {table: T, primaryKey: a, columns: [A, b]}\ntarget: {type: console, primaryKey: [b]}\nincremental: {overlap: 1h, batchRows: 7}\n")
    assert (cfg.name, cfg.mode, cfg.source.pool_max, cfg.read.primary_key, cfg.read.columns, cfg.key) == ("j", "full", 3, ["a"], ["A", "b"], ["b"])
    assert cfg.incremental.lookback == timedelta(hours=1) and cfg.incremental.batch_rows == 7
    assert config.loads('{"source": {"url": "x"}, "read": {"table": "t"}, "target": {"type": "console"}}').splits.num_partitions == 1


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"source": {}}, "source.url"),
        ({"read": {}}, "read.table"),
        ({"read": {"mode": "query"}}, "read.query"),
        ({"read": {"mode": "query", "query": "select 1"}}, "primary key"),
        ({"read": {"mode": "query", "query": "q", "primaryKey": ["a"]}, "deleteDetect": {"mode": "pk_diff"}}, "query mode"),
        ({"deleteDetect": {"mode": "soft_column"}}, "softColumn"),
        ({"target": {"type": "jdbc", "url": "u", "table": "t"}}, "primaryKey"),
        ({"target": {"type": "kafka"}}, "brokers"),
        ({"target": {"type": "doris", "httpUrl": "h"}}, "database"),
        ({"splits": {"numPartitions": 0}}, "numPartitions"),
        ({"runtime": {"writeBatchSize": 0}}, "writeBatchSize"),
        ({"quality": {"sampleHashCheck": 1.5}}, "sampleHashCheck"),
        ({"mode": "sideways"}, "mode"),
        ({"incremental": {"overlap": "soon"}}, "duration"),
    ],
)
def test_config_rules(change, message):
    with pytest.raises(ValueError, match=message):
        config.from_dict(base(**change)).validate()


# ---------------------------------------------------------------- values


def test_normalized_values(spark):
    t = spark.sql("SELECT CAST(1 AS INT) i, 1L l, 1.00BD d, 1.0D f, 100BD h, 0.10BD z, TIMESTAMP_NTZ '2024-01-01 00:00:00.000001' ts, '2024-01-01T00:00:00.000001' iso, ' x ' s, CAST(NULL AS STRING) n, DATE '2024-01-01' day, CAST('NaN' AS DOUBLE) nan, X'00ff' b, true yes")
    got = t.select(*(normalize(F.col(c), t.schema[c].dataType).alias(c) for c in t.columns)).first()
    assert got.i == got.l == got.d == got.f == "1"
    assert (got.h, got.z, got.s, got.n, got.day, got.nan, got.b, got.yes) == ("100", "0.1", " x ", None, "2024-01-01", "NaN", "00FF", "true")
    assert got.ts == got.iso == "1704067200000001"


def test_same_is_null_safe_and_crosses_types(spark):
    t = spark.sql("SELECT 1 a, 1.00BD b, '1' c, CAST(NULL AS INT) n, '' e, true y, TIMESTAMP_NTZ '2024-01-01 10:00:00' ts, '2024-01-01 10:00:00' tx")
    eq = lambda x, y: same(F.col(x), t.schema[x].dataType, F.col(y), t.schema[y].dataType)
    pairs = [("a", "b", True), ("a", "c", True), ("n", "n", True), ("n", "e", False), ("a", "n", False), ("a", "y", False), ("ts", "tx", True)]
    assert list(t.select(*(eq(x, y).alias(f"r{i}") for i, (x, y, _) in enumerate(pairs))).first()) == [w for *_, w in pairs]


def test_row_hash_sees_nulls_and_order(spark):
    t = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, None, "a")], "id int, x string, y string")
    h = [r[0] for r in t.select(row_hash(t)).collect()]
    assert h[0] == h[2] != h[1]


# ---------------------------------------------------------------- cursors


def T_(*args):
    return datetime(2024, 1, 1, *args)


EVENTS = [(1, T_(0)), (2, T_(1)), (3, T_(1)), (4, T_(1)), (5, T_(1)), (6, T_(2)), (-7, T_(1)), (8, None)]


def events(spark):
    return spark.createDataFrame(EVENTS, "id long, update_time timestamp_ntz")


def inc(**more):
    return config.Incremental(**({"overlap": "0s"} | more))


@pytest.mark.parametrize(
    ("how", "start", "want"),
    [
        (inc(strategy="id"), Watermark(T_(9), 4), [5, 6, 8]),
        (inc(strategy="update_time"), Watermark(T_(1), 3), [-7, 2, 3, 4, 5, 6]),
        (inc(), Watermark(T_(1), 3), [4, 5, 6]),
        (inc(), Watermark(T_(1)), [-7, 2, 3, 4, 5, 6]),
        (inc(), Watermark(None, 4), [5, 6, 8]),
        (inc(), Watermark(), [-7, 1, 2, 3, 4, 5, 6, 8]),
        (inc(overlap="2h"), Watermark(T_(2), 6), [-7, 2, 3, 4, 5]),
        (inc(strategy="full"), Watermark(T_(2), 6), [-7, 1, 2, 3, 4, 5, 6, 8]),
    ],
)
def test_cursor_predicates(spark, how, start, want):
    got = sorted(r.id for r in cursor.incremental(events(spark), how, start).collect())
    assert got == want or how.overlap == "2h" and set(want) <= set(got)


def test_capped_passes_reach_every_row_once(spark):
    """Also where one timestamp has more rows than the cap."""
    many = spark.createDataFrame([(i, T_(i // 12)) for i in range(50)], "id long, update_time timestamp_ntz")
    how, mark, seen = inc(max_rows_per_run=7), Watermark(), []
    for _ in range(8):
        part = cursor.incremental(many, how, mark)
        seen += [r.id for r in part.collect()]
        mark = mark.later(cursor.reached(part, how))
    assert sorted(seen) == list(range(50))


def test_a_capped_pass_goes_on_despite_a_wide_lookback(spark):
    many = spark.createDataFrame([(i, T_(0, i)) for i in range(40)], "id long, update_time timestamp_ntz")
    how, mark = inc(max_rows_per_run=5, overlap="1h"), Watermark()
    for _ in range(8):
        mark = mark.later(cursor.reached(cursor.incremental(many, how, mark), how))
    assert mark.id == 39


def test_reached_cursors(spark):
    assert cursor.reached(events(spark), inc()) == Watermark(T_(2), 6)
    assert cursor.reached(events(spark), inc(strategy="id")) == Watermark(None, 8)  # not the id of the newest row
    assert cursor.reached(events(spark).limit(0), inc()) == Watermark()
    assert Watermark(T_(1), 5).later(Watermark(T_(1), 9)).id == 9
    assert Watermark(None, 99).later(Watermark(T_(0))) == Watermark(T_(0))


def test_cursor_filter_reaches_the_scan(spark):
    df = cursor.incremental(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderdate"), config.Incremental(column="o_orderdate", id_column="o_orderkey", overlap="0s"), Watermark(datetime(1998, 1, 1), 7))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "o_totalprice" not in plan


# ---------------------------------------------------------------- splits


@given(st.integers(-50, 50), st.integers(0, 80), st.integers(1, 9))
def test_ranges_cover_everything_once(low, width, parts):
    shards = splits.cut("k", low, low + width, parts)
    assert len(shards) <= parts and shards[0].lo is None and shards[-1].hi is None
    for k in range(low - 3, low + width + 4):
        assert sum((s.lo is None or k >= s.lo) and (s.hi is None or k < s.hi) for s in shards) == 1


@pytest.mark.parametrize("strategy", ["range", "mod", "hash", "auto"])
def test_every_row_is_in_one_shard(spark, strategy):
    """Negative and NULL keys, too."""
    t = spark.createDataFrame([(k,) for k in [None, -9, -4, -3, 0, 1, 5, 6, 1000, None]], "k long")
    plan = splits.plan(t, "k", 3, strategy)
    assert sum(t.where(s.predicate()).count() for s in plan.shards) == 10
    assert splits.tagged(t, plan).where("shard is null").count() == 0
    assert plan.mode == {"auto": "range"}.get(strategy, strategy)


def test_what_cannot_be_split_is_one_shard(spark):
    t = spark.createDataFrame([("a",), ("b",)], "code string")
    assert splits.plan(t, "code", 4, "auto", can_hash=False).warnings and len(splits.plan(t, "code", 4, "range", can_hash=False).shards) == 1
    assert splits.plan(t, "code", 4).mode == "hash"
    assert splits.plan(t, "absent", 4).warnings
    assert len(splits.plan(t, "code", 1).shards) == len(splits.plan(t.limit(0).select(F.lit(1).alias("n")), "n", 4).shards) == 1


def test_plan_id_follows_what_shards_mean(spark):
    t = spark.range(10)
    a, b = splits.plan(t, "id", 2), splits.plan(spark.range(20), "id", 2)
    make = lambda p, where="": splits.plan_id("s", ["id"], where, "id", p)
    assert make(a) == make(splits.plan(t, "id", 2)) and len({make(a), make(b), make(a, "x > 1")}) == 3


# ---------------------------------------------------------------- diffs


def test_diff_of_the_example(spark):
    s = spark.createDataFrame([(i, f"n{i}", Decimal("1.00")) for i in range(1, 26)], "id long, name string, amount decimal(10,2)")
    t = spark.createDataFrame([(i, "stale" if i == 12 else f"n{i}", Decimal("1.0")) for i in range(1, 31) if i not in (3, 17)], "id long, name string, amount decimal(12,4)")
    got = diff.classify(s, t, ["id"])
    assert tuple(diff.summary(got).first()) == (2, 1, 5, 22)
    after = merge.apply_changes(t, diff.diff(s, t, ["id"]), ["id"])
    assert tuple(diff.summary(diff.classify(s, after, ["id"])).first()) == (0, 0, 0, 25)
    assert tuple(diff.summary(diff.classify(s, t, ["id"], compare=False)).first())[1] == 0


def test_diff_with_nulls_dates_composite_keys_and_missing_columns(spark):
    s = spark.createDataFrame([(1, None, date(2024, 1, 1), "a"), (1, 2, None, None), (None, 3, date(2024, 1, 3), "c")], "a long, b long, day date, extra string")
    t = spark.createDataFrame([(1, None, date(2024, 1, 1)), (1, 2, None), (None, 9, None)], "a long, b long, day date")
    got = {(r.a, r.b): r[OP] for r in diff.classify(s, t, ["a", "b"]).collect()}
    assert got == {(1, None): "u", (1, 2): "=", (None, 3): "i", (None, 9): "d"}
    after = merge.apply_changes(t, diff.diff(s, t, ["a", "b"]), ["a", "b"])
    assert diff.diff(s, after, ["a", "b"]).count() == 0 and after.columns == ["a", "b", "day", "extra"]
    assert diff.diff(s, t.limit(0), ["a", "b"]).count() == 3
    with pytest.raises(ValueError, match="primary key"):
        diff.diff(s, t, [])


def test_diff_is_one_equi_join(spark):
    plan = diff.classify(spark.range(5), spark.range(3), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Join") == 1


@pytest.mark.parametrize(
    ("kind", "given", "values"),
    [
        (T.BooleanType(), None, {True: True, False: False, None: False}),
        (T.IntegerType(), None, {1: True, 0: False, -2: True, None: False}),
        (T.DoubleType(), None, {0.5: False, -0.5: False, 1.0: True}),
        (T.StringType(), None, {"1": True, "TRUE": True, " y": True, "no": False, "": False, None: False}),
        (T.StringType(), ["gone", " Old "], {"GONE ": True, "old": True, "1": False, None: False}),
        (T.IntegerType(), ["7"], {7: True, 1: False}),
    ],
)
def test_soft_delete_flags(spark, kind, given, values):
    t = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("f", kind)]))
    assert {r.f: r.d for r in t.select("f", diff.is_deleted(F.col("f"), kind, given).alias("d")).collect()} == values


# ---------------------------------------------------------------- merges


def test_last_change_of_a_key_wins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, None, "d", 2), (1, "again", "u", 3), (2, "b2", "u", 1), (2, None, "DELETE", 2), (4, "new", "i", 1)], "id long, v string, _op string, seq int")
    got = merge.apply_changes(t, changes, ["id"], [F.col("seq")]).select("id", "v")
    assert rows(got) == [(1, "again"), (3, "c"), (4, "new")]
    unordered = merge.apply_changes(t, changes.drop("seq"), ["id"])
    assert rows(unordered) == [(3, "c"), (4, "new")]
    assert rows(merge.apply_changes(unordered, changes.drop("seq"), ["id"])) == rows(unordered)


def test_columns_are_only_added(spark):
    t = spark.createDataFrame([(1, "a")], "ID long, gone string")
    s = T.StructType().add("id", "long").add("extra", "decimal(9,3)").add(OP, "string")
    assert [f.name for f in merge.missing_columns(s, t.schema)] == ["extra"]
    assert merge.evolve(t, s).columns == ["ID", "gone", "extra"]
    kinds = [merge.column_type(k) for k in (T.LongType(), T.IntegerType(), T.DecimalType(9, 3), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.StringType())]
    assert kinds == ["BIGINT", "INT", "DECIMAL(9,3)", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP", "VARCHAR(1024)"]


# ---------------------------------------------------------------- fingerprints and checks


def test_fingerprints_ignore_row_order_but_not_rows(spark):
    t = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(50)], "id long, v string")
    one = lambda df: fingerprint.text(fingerprint.table(df).first())
    assert one(t) == one(t.orderBy(F.desc("id")).repartition(5))
    assert len({one(t), one(t.union(t.limit(2)).union(t.limit(2))), one(t.where("id < 49")), one(t.limit(0))}) == 4
    assert one(t.unionByName(t.where("id = 1"))) != one(t)
    part = F.col("id") % 4
    changed = fingerprint.changed(fingerprint.by_partition(t, part), fingerprint.by_partition(t.where("id != 6"), part))
    assert rows(changed) == [(2, "changed")]


def test_quality_checks(spark):
    assert quality.target_count(5, 0, 3).ok is False and quality.target_count(5, 1, 3).ok and quality.target_count(5, 0, None).ok
    assert quality.watermark_lag(Watermark(T_(0)), 1000, T_(1)).ok is False and quality.watermark_lag(Watermark(), 1000, T_(1)) is None
    bad = [quality.Check("a", False)]
    assert [quality.verdict([None], True), quality.verdict(bad, False), quality.verdict(bad, True)] == ["SUCCESS", "QUALITY_WARN", "QUALITY_FAILED"]
    t = spark.createDataFrame([(i, str(i), None if i else "d") for i in range(30)], "id long, v string, _op string")
    sample = quality.stride_sample(t, ["id"], 0.2)
    assert sample.count() == 6 and sample.where("id = 0").count() == 0
    assert quality.stride_sample(t.limit(0), ["id"], 0.2).count() == 0
    assert rows(quality.sample_mismatches(t.drop("_op").where("id < 4"), t.select("id", F.when(F.col("id") == 2, "z").otherwise(F.col("v")).alias("v")).where("id != 1"), ["id"])) == [(1, "missing"), (2, "different")]
    assert [r.id for r in quality.stride_sample(t.repartition(7), ["id"], 0.1).collect()] == [1, 10, 19]
    twice = t.unionByName(t).withColumn("k", F.when(F.col("id") > 20, F.col("id")))
    assert 0 < quality.stride_sample(twice, ["k"], 0.1).count() <= 60  # all rows of a key that was taken
    some = [r.id for r in quality.random_sample(t, ["id"], 0.2, seed=1).collect()]
    assert len(some) == 6 and 0 not in some and some == [r.id for r in quality.random_sample(t.repartition(9), ["id"], 0.2, seed=1).collect()]
    assert some != [r.id for r in quality.random_sample(t, ["id"], 0.2, seed=2).collect()]


def test_fingerprint_windows_and_both_sides(spark):
    t = spark.createDataFrame([(i, T_(i % 5), f"v{i}") for i in range(20)] + [(99, None, "x")], "id long, ts timestamp_ntz, v string")
    other = t.where("id != 7").withColumn("v", F.when(F.col("id") == 3, "drift").otherwise(F.col("v")))
    assert fingerprint.window(t, "id", 3, 8).count() == 5 and fingerprint.window(t, "id", hi=3).count() == 3
    a, b = fingerprint.moved(t, other, "id")
    assert (rows(a.select("id")), rows(b.select("id"))) == ([(3,), (7,)], [(3,)])
    a, b = fingerprint.moved(t, t.repartition(3), "ts")
    assert a.count() == b.count() == 0
    assert fingerprint.moved(t, other, "")[0].count() == 21
    assert fingerprint.partition_of(t, "ts")._jc.toString().startswith("to_date")


def test_preflight(spark):
    t = events(spark)
    cfg = config.from_dict(base(read={"table": "t", "primaryKey": ["id"]}, splits={"numPartitions": 4, "column": "ID"}))
    codes = lambda *a, **k: [(f.level, f.code) for f in quality.preflight(*a, **k)]
    assert codes(cfg, t, Watermark()) == []
    assert codes(cfg, None, Watermark()) == [("ERROR", "SOURCE_UNREADABLE")]
    assert codes(cfg, t, Watermark(T_(2) + timedelta(seconds=59))) == []
    assert codes(cfg, t, Watermark(T_(3))) == [("ERROR", "WATERMARK_REGRESSION")]
    assert codes(cfg, t, Watermark(), indexed={"id"}) == [("WARN", "NO_INDEX")]
    assert codes(cfg, t, Watermark(), target_reachable=False) == [("ERROR", "TARGET_UNREACHABLE")]
    cfg.incremental.column = ""
    assert codes(cfg, t, Watermark()) == [("ERROR", "COLUMN_UNSET")]


# ---------------------------------------------------------------- SQL of databases


@pytest.mark.parametrize(
    ("name", "select", "upsert"),
    [
        ("mysql", "SELECT `a` FROM t WHERE (x) AND (y) ORDER BY `a` LIMIT 3", "INSERT INTO t (`a`, `b`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)"),
        ("postgresql", 'SELECT "a" FROM t WHERE (x) AND (y) ORDER BY "a" LIMIT 3', 'INSERT INTO t ("a", "b") VALUES (?, ?) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'),
        ("oracle", 'SELECT "a" FROM t WHERE (x) AND (y) ORDER BY "a" FETCH FIRST 3 ROWS ONLY', 'MERGE INTO t t USING (SELECT ? AS "a", ? AS "b" FROM dual) s ON (t."a" = s."a") WHEN MATCHED'),
        ("sqlserver", "SELECT TOP (3) [a] FROM t WHERE (x) AND (y) ORDER BY [a]", "MERGE INTO t t USING (SELECT ? AS [a], ? AS [b]) s ON (t.[a] = s.[a])"),
        ("h2", "SELECT a FROM t WHERE (x) AND (y) ORDER BY a LIMIT 3", "MERGE INTO t (a, b) KEY (a) VALUES (?, ?)"),
    ],
)
def test_dialects(name, select, upsert):
    d = dialects.by_name(name)
    assert d.select(["a"], "t", ["x", " ", "y"], ["a"], 3) == select
    assert d.upsert("t", ["a", "b"], ["a"]).startswith(upsert)
    assert d.quote(d.quote("a.b")) == d.quote("a.b")
    assert "SET" not in d.upsert("t", ["a"], ["a"]) or name == "mysql"
    assert all(x.startswith(("INSERT INTO t", "MERGE INTO t")) for x in d.upsert_staged("t", "s", ["a", "b"], ["a"]))
    assert d.delete_staged("t", "s", ["a"]).startswith("DELETE FROM t WHERE EXISTS (SELECT 1 FROM s s WHERE t.")


def test_dialects_by_url_and_the_rest():
    assert [dialects.by_url(u).name for u in ("jdbc:mysql://h/d", "jdbc:oracle:thin:@h", "jdbc:h2:mem:x", "jdbc:other:x", "/data")] == ["mysql", "oracle", "h2", "standard", "standard"]
    assert dialects.STANDARD.select([], "t") == "SELECT * FROM t" and dialects.by_name("mariadb") is dialects.MYSQL
    with pytest.raises(ValueError, match="no upsert"):
        dialects.STANDARD.upsert("t", ["a"], ["a"])
    assert dialects.SQLSERVER.add("t", "c", "INT") == "ALTER TABLE t ADD [c] INT" and dialects.ORACLE.timestamp(T_(1)) == "TIMESTAMP '2024-01-01 01:00:00.000000'"
    assert dialects.MYSQL.shard(splits.Shard("hash", "c", n=4, remainder=1)) == "MOD(CRC32(`c`), 4) = 1"
    assert dialects.POSTGRES.shard(splits.Shard("range", "c", 1, None)) == '"c" >= 1'
    with pytest.raises(ValueError, match="hash"):
        dialects.H2.shard(splits.Shard("hash", "c", n=4))


def test_payloads(spark):
    t = spark.createDataFrame([(1, None, "d"), (2, "x", None)], "id long, v string, _op string")
    assert rows(sinks.kafka_rows(t, ["id", "v"]).select("key")) == [("1|",), ("2|x",)]
    assert rows(sinks.kafka_rows(t, []).select(F.length("key") > 3)) == [(True,), (True,)]
    assert [r.value for r in sinks.doris_rows(t).collect()] == ['{"id":1,"v":null,"__DORIS_DELETE_SIGN__":"1"}', '{"id":2,"v":"x","__DORIS_DELETE_SIGN__":"0"}']


# ---------------------------------------------------------------- job files


NESTED = """
name: nested
mode: incremental
source:
  type: mysql
  url: jdbc:mysql://h/db
  poolMax: 3
  read:
    table: orders
    primaryKey: [id]
    filter: "status <> 'TEST'"
    incremental: {strategy: update_time_id, column: changed, idColumn: id, overlap: 10m, maxRowsPerRun: 500}
    splits: {column: id, numPartitions: 4, mode: parallel, strategy: range}
    deleteDetect: {mode: fingerprint, fingerprintColumn: changed}
runtime: {maxConcurrentQueries: 9, extractThreads: 5}
target:
"""
TARGETS = {
    "  {type: file, path: ./o.jsonl, format: jsonl}": {"path": "./o.jsonl"},
    "  {type: jdbc, url: 'jdbc:mysql://h/d', table: o, primaryKey: [id]}": {"table": "o"},
    "  {type: kafka, bootstrapServers: 'a:1,b:2', topic: t, acks: all}": {"brokers": "a:1,b:2", "acks": "all"},
    "  {type: doris, feHost: 10.0.0.1, fePort: 8031, database: dw, table: o}": {"http_url": "http://10.0.0.1:8031"},
    "  {type: starrocks, feHost: h, database: dw, table: o}": {"http_url": "http://h:8030"},
    "  {type: paimon, warehouse: 'hdfs:///lake', catalogDb: ods, paimonTable: o, options: {bucket: '4'}}": {"table": "o", "catalog_db": "ods", "options": {"bucket": "4"}},
    "  {type: 'test_engine:Odd'}": {"type": "test_engine:Odd"},
}


class Odd(sinks.Sink):
    def write(self, rows):
        pass


@pytest.mark.parametrize("target", TARGETS)
def test_job_files_with_nested_sections(target):
    cfg = config.loads(NESTED + target)
    assert (cfg.read.table, cfg.incremental.column, cfg.incremental.max_rows_per_run, cfg.splits.num_partitions, cfg.delete_detect.fingerprint_column) == ("orders", "changed", 500, 4, "changed")
    assert cfg.queries_at_once == 3 and cfg.incremental.lookback == timedelta(minutes=10)
    assert {k: getattr(cfg.target, k) for k in TARGETS[target]} == TARGETS[target]


def test_types_by_name(spark, tmp_path):
    from keelson import state

    cfg = config.from_dict(base(target={"type": "test_engine:Odd"})).validate()
    assert isinstance(sinks.open_sink(spark, cfg), Odd)
    sinks.register("odd", Odd, required=("topic",))
    with pytest.raises(ValueError, match="topic"):
        config.from_dict(base(target={"type": "odd"})).validate()
    state.register("elsewhere", lambda s, c: ("made", c.path))
    assert state.open_state(spark, config.State(type="elsewhere", path="p")) == ("made", "p")
    with pytest.raises(ValueError, match="state.type"):
        state.open_state(spark, config.State(type="nowhere"))
    dialects.register("mine", dialects.MYSQL)
    assert dialects.by_url("jdbc:mine://h") is dialects.MYSQL and dialects.by_name("keelson.sources.dialects:ORACLE") is dialects.ORACLE


def test_statements_of_a_paimon_table(spark):
    cfg = config.loads(NESTED + "  {type: paimon, warehouse: 'file:///tmp/none', catalogDb: ods, table: o, primaryKey: [id], options: {bucket: '4'}}")
    sink = sinks.PaimonSink(spark, cfg)
    rows_ = spark.createDataFrame([(1, "a", "d")], "id long, v string, _op string")
    assert sink.create(rows_) == "CREATE TABLE IF NOT EXISTS keelson_paimon.ods.o (`id` bigint, `v` string) TBLPROPERTIES ('primary-key' = 'id', 'bucket' = '4')"
