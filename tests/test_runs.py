"""Whole runs: full, incremental, diff, check; resume, crashes, state, sinks, streaming, command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keelson import cli, config
from keelson.operators.cursor import Watermark
from keelson.plans.runner import Job, PlanChanged, throttle_seconds, with_retry
from keelson.sources import sinks
from keelson.state import FileState, JdbcState, RunReport, mark_of, mark_text
from keelson.streaming import polling


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def place(spark, tmp_path):
    """A source folder and a job over it that merges into a snapshot table."""

    def save(data, name="t"):
        spark.createDataFrame(data, "id long, name string, update_time timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/src/{name}.parquet")

    def job(**more):
        values = {
            "name": "j",
            "source": {"type": "parquet", "url": f"{tmp_path}/src"},
            "read": {"table": "t.parquet", "primaryKey": ["id"]},
            "target": {"type": "parquet", "path": f"{tmp_path}/out", "primaryKey": ["id"]},
            "state": {"path": f"{tmp_path}/state"},
            "incremental": {"overlap": "0s"},
            "runtime": {"retryBackoffMs": 1, "retryJitterMs": 0},
        }
        for k, v in more.items():
            values[k] = values.get(k, {}) | v if isinstance(v, dict) else v
        return Job(spark, config.from_dict(values).validate())

    job.save, job.path = save, tmp_path
    return job


def there(job):
    return sorted((r.id, r.name) for r in job.sink.read().collect())


def test_full_then_incremental(place):
    place.save([(i, f"n{i}", at(i)) for i in range(4)] + [(9, None, None)])
    job = place()
    report = job.run("full")
    assert (report.status, report.rows_read, report.end) == ("SUCCESS", 5, "2024-01-01T00:03:00|3"), report
    place.save([(3, "changed", at(5)), (4, "late", at(3)), (6, "new", at(6))])
    report = place().run()
    assert report.rows_read == 3 and there(job) == [(0, "n0"), (1, "n1"), (2, "n2"), (3, "changed"), (4, "late"), (6, "new"), (9, None)]
    assert place().run().rows_read == 0
    assert job.state.watermark("j") == Watermark(at(6), 6)


def test_cursor_never_goes_back(place):
    place.save([(1, "a", at(1))])
    job = place(incremental={"overlap": "1h"})
    job.state.save_watermark("j", Watermark(at(30), 9))
    job.run()
    assert job.state.watermark("j") == Watermark(at(30), 9)


def test_full_resumes_after_a_crash(place, monkeypatch):
    place.save([(i, f"n{i}", at(i)) for i in range(12)])
    job = place(splits={"numPartitions": 4})
    real, calls = job.sink.write, []

    def failing(rows):
        calls.append(1)
        if len(calls) > 2:
            raise OSError("gone")
        real(rows)

    monkeypatch.setattr(job.sink, "write", failing)
    report = job.run("full")
    assert report.status == "FAILED" and "gone" in report.message and report.retries == 2
    again = place(splits={"numPartitions": 4}).run("full")
    assert (again.status, again.rows_read, again.shards, again.shards_skipped, again.end) == ("SUCCESS", 6, 4, 2, "2024-01-01T00:11:00|11")
    assert len(there(job)) == 12 and job.state.keys("j") == ["watermark"]


def test_progress_of_another_plan_is_dropped(place):
    place.save([(i, "x", at(i)) for i in range(6)])
    job = place(splits={"numPartitions": 3})
    job.state.mark_done("j", "otherplan", 0, Watermark())
    assert job.run("full").shards_skipped == 0
    assert not [k for k in job.state.keys("j") if k.startswith("full-")]


def test_shards_for_an_outside_scheduler(place):
    place.save([(i, "x", at(i)) for i in range(6)])
    job = place(splits={"numPartitions": 3})
    plan, plan_id = job.plan()
    assert [s.label for s in plan.shards] == ["[-inf,2)", "[2,4)", "[4,inf)"]
    assert job.run_shard(1, plan_id)["rows"] == 2 and job.run_shard(1)["skipped"]
    with pytest.raises(PlanChanged):
        job.run_shard(0, "stale")
    with pytest.raises(ValueError, match="3 shards"):
        job.run_shard(7)


def test_diff_converges(place):
    place.save([(1, "keep", at(1)), (2, "upd", at(1)), (3, "new", at(1))])
    job = place(deleteDetect={"mode": "pk_diff"})
    job.sink.write(job.spark.createDataFrame([(1, "keep", at(1)), (2, "old", at(1)), (9, "gone", at(1))], "id long, name string, update_time timestamp_ntz"))
    report = job.run("diff")
    assert (report.inserts, report.rewrites, report.deletes, report.unchanged, report.rows_written) == (1, 1, 1, 1, 3), report
    assert job.run("diff").rows_written == 0 and there(job) == [(1, "keep"), (2, "upd"), (3, "new")]
    assert job.state.watermark("j").empty


def test_repeated_keys_are_reported(place):
    place.save([(1, "a", at(1)), (1, "b", at(1)), (None, "c", at(2)), (None, "d", at(2))])
    report = place(deleteDetect={"mode": "pk_diff"}, quality={"preflightEnabled": True}).run("diff")
    assert [f["message"].split(" share")[0] for f in report.findings if f["code"] == "KEY_REPEATED"] == ["rows of the source"]


def test_fingerprint_is_kept_only_after_the_diff_is_applied(place, monkeypatch):
    place.save([(1, "a", at(1)), (2, "b", at(1))])
    job = place(deleteDetect={"mode": "fingerprint"})
    real = job.sink.write
    monkeypatch.setattr(job.sink, "write", lambda rows: (_ for _ in ()).throw(OSError("down")))
    assert job.run("diff").status == "FAILED" and job.state.get("j", "fingerprint") is None
    monkeypatch.setattr(job.sink, "write", real)
    assert job.run("diff").rows_written == 2
    skipped = job.run("diff")
    assert skipped.rows_read == 0 and skipped.findings[0]["code"] == "UNCHANGED"


def test_write_only_targets_are_never_taken_for_empty(place):
    place.save([(1, "a", at(1))])
    report = place(deleteDetect={"mode": "pk_diff"}, target={"type": "file", "path": "x"}).run("diff")
    assert report.status == "FAILED" and "read back" in report.message


def test_soft_deletes_remove_rows(place):
    place.save([(1, "0", at(1)), (2, "1", at(1))])
    job = place(deleteDetect={"mode": "soft_column", "softColumn": "name"})
    job.run("full")
    assert job.run("diff").deletes == 1 and there(job) == [(1, "0")]
    assert place().run("diff").findings[0]["code"] == "NO_DELETE_DETECT"


def test_schema_grows_and_old_rows_have_nulls(place):
    place.save([(1, "a", at(1))])
    job = place()
    job.run("full")
    job.sink.write(job.spark.createDataFrame([(2, "b", "more")], "id long, name string, extra string"))
    assert sorted((r.id, r.extra) for r in job.sink.read().collect()) == [(1, None), (2, "more")]


def test_quality_and_preflight(place):
    place.save([(1, "a", at(1)), (2, "b", at(2))])
    ok = place(quality={"sampleHashCheck": 1.0, "preflightEnabled": True, "watermarkMaxLagMs": 1000})
    report = ok.run("full")
    assert [c["name"] for c in report.checks if c["ok"]] == ["row_count", "target_count", "sample_hash"] and report.status == "QUALITY_WARN"
    strict = place(quality={"watermarkMaxLagMs": 1000, "failOnQualityMismatch": True}).run("full")
    assert strict.status == "QUALITY_FAILED" and strict.rows_written == 2
    bad = place(read={"columns": ["nope"]}, quality={"preflightEnabled": True})
    assert "COLUMN_MISSING" in bad.run("full").message and bad.run("check").status == "FAILED"
    assert place().run("check").status == "SUCCESS"


def test_query_mode(place, spark):
    place.save([(1, "a", at(1)), (2, "b", at(2))])
    spark.read.parquet(f"{place.path}/src/t.parquet").createOrReplaceTempView("src_view")
    job = place(read={"mode": "query", "query": "SELECT id, upper(name) AS name, update_time FROM src_view WHERE id > 1", "table": ""})
    assert job.run("full").rows_read == 1 and there(job) == [(2, "B")]


# ---------------------------------------------------------------- state


@pytest.fixture(params=["file", "jdbc"])
def store(request, spark, tmp_path):
    return FileState(spark, f"{tmp_path}/s") if request.param == "file" else JdbcState(spark, f"jdbc:derby:memory:{tmp_path.name};create=true")


def test_state(store):
    assert store.watermark("j").empty and store.runs() == []
    for mark in (Watermark(at(1), -5), Watermark(None, 7), Watermark(at(2)), Watermark()):
        store.save_watermark("j", mark)
        assert store.watermark("j") == mark == mark_of(mark_text(mark))
    store.mark_done("j", "p", 0, Watermark(at(1), 1))
    store.mark_done("j", "p", 11, Watermark(None, 5))
    store.mark_done("j", "q", 3, Watermark(at(1)))
    assert store.done("j", "p") == {0: Watermark(at(1), 1), 11: Watermark(None, 5)}
    store.clear_progress("j", keep_plan="p")
    assert store.done("j", "q") == {} and len(store.done("j", "p")) == 2
    for i in range(3):
        store.add_run(RunReport(run_id=f"r{i}", job="j" if i else "other", status="QUALITY_FAILED", started_at=f"2024-01-0{i + 1}T00:00:00"))
    assert [r.run_id for r in store.runs()] == ["r2", "r1", "r0"] and [r.run_id for r in store.runs("j", 1)] == ["r2"]
    assert store.runs("j")[0].status == "QUALITY_FAILED"
    store.reset("j")
    assert store.keys("j") == []


def test_reports_that_cannot_be_read_are_skipped(spark, tmp_path):
    store = FileState(spark, f"{tmp_path}/s")
    store.add_run(RunReport(job="j", started_at="2024"))
    (tmp_path / "s/runs/9999.json").write_text("{broken")
    assert len(store.runs()) == 1 and RunReport.from_json("[1]") is None


def test_retry_and_rate():
    cfg, tries, waits = config.JobConfig(), [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return "done"

    assert with_retry(cfg, flaky, sleep=waits.append) == "done" and len(waits) == 2 and 0.5 <= waits[0] <= 0.75 and 1 <= waits[1] <= 1.25
    with pytest.raises(ValueError):
        with_retry(cfg, lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    assert len(waits) == 2 and throttle_seconds(5000, 0.5, 2000) == 2.0 and throttle_seconds(5, 1, 0) == 0


# ---------------------------------------------------------------- sinks


def test_files_keep_nulls_and_one_header_each(place, spark):
    place.save([(1, None, at(1)), (2, 'q"uo,te', at(2))])
    for kind in ("json", "csv", "tsv", "parquet"):
        job = place(target={"type": "file", "format": kind, "path": f"{place.path}/{kind}"}, name=kind)
        assert job.run("full").status == "SUCCESS"
    assert '"name":null' in "".join(r.value for r in spark.read.text(f"{place.path}/json").collect())
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        back = spark.read.csv(f"{place.path}/{kind}", header=True, sep=sep, escape="\\")
        assert back.count() == 2 and back.columns == ["id", "name", "update_time"]


def test_jdbc_target_and_source(place, spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name}x;create=true"
    manager = spark._jvm.java.sql.DriverManager

    def run(sql):
        c = manager.getConnection(url)
        c.createStatement().executeUpdate(sql)
        c.close()

    run('CREATE TABLE T ("id" BIGINT NOT NULL PRIMARY KEY, "name" VARCHAR(50), "update_time" TIMESTAMP)')
    place.save([(i, f"n{i}", at(i)) for i in range(6)])
    target = {"type": "jdbc", "url": url, "table": "T", "path": ""}
    job = place(target=target, deleteDetect={"mode": "pk_diff"})
    report = job.run("full")
    assert report.status == "SUCCESS", report.message
    place.save([(0, "zero", at(9)), (7, "seven", at(9))])
    report = place(target=target, deleteDetect={"mode": "pk_diff"}).run("diff")
    assert (report.inserts, report.rewrites, report.deletes) == (1, 1, 5), report.message
    assert there(job) == [(0, "zero"), (7, "seven")]
    job.sink.write(spark.createDataFrame([(8, "eight", 5)], "id long, name string, extra int"))
    assert "extra" in job.sink.read().columns and job.sink.reachable()
    # the same table as a source, one partition for each shard
    src = place(source={"type": "derby", "url": url}, read={"table": "T", "primaryKey": ["id"], "columns": ["id", "name"]}, splits={"numPartitions": 2}, runtime={"fullCheckpoint": False}, target={"path": f"{place.path}/back"})
    plan, _ = src.plan()
    assert src.source(plan).rdd.getNumPartitions() == 2
    assert src.run("full").rows_read == 3 and there(src) == [(0, "zero"), (7, "seven"), (8, "eight")]
    from keelson.sources.scan import indexed_columns

    assert indexed_columns(spark, src.cfg) == {"id"}


def test_shards_are_read_some_at_a_time_and_pushed_down(place, spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:memory:{tmp_path.name}p;create=true"
    spark.range(40).withColumn("name", F.lit("n")).withColumn("update_time", F.lit(at(1)).cast("timestamp")).write.option("createTableColumnTypes", "name VARCHAR(9)").jdbc(url, "S")
    job = place(source={"type": "derby", "url": url}, read={"table": "S", "primaryKey": ["id"], "columns": ["name", "id"]}, splits={"numPartitions": 8, "strategy": "mod", "mode": "parallel"}, runtime={"extractThreads": 3}, incremental={"strategy": "id"})
    seen, real = [], job.sink.write

    def write(rows):
        seen.append(rows.count())
        real(rows)

    monkeypatch.setattr(job.sink, "write", write)
    report = job.run("full")
    assert (report.status, report.rows_read, seen, report.end) == ("SUCCESS", 40, [15, 15, 10], "|39"), report.message
    assert len(there(job)) == 40
    from keelson.sources import scan

    some = scan.read(spark, job.cfg, shards=list(job.plan()[0].shards[:2]))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.id % 8 for r in some.collect()) == [0] * 5 + [1] * 5


def test_rows_are_held_back_while_they_are_read(place):
    place.save([(i, "x", at(1)) for i in range(600)])
    job = place(runtime={"maxRowsPerSec": 400})
    began = datetime.now()
    report = job.run("full")
    assert report.rows_read == 600 and (datetime.now() - began).total_seconds() > 1 and report.throttled_ms >= 1000, report


def test_fingerprint_sees_a_target_that_drifted(place):
    place.save([(i, f"n{i}", datetime(2024, 1, 1 + i % 3)) for i in range(9)])
    job = place(deleteDetect={"mode": "fingerprint", "fingerprintColumn": "update_time"})
    assert job.run("diff").inserts == 9
    job.sink.write(job.spark.createDataFrame([(4, "drift", datetime(2024, 1, 2))], "id long, name string, update_time timestamp_ntz"))
    report = job.run("diff")
    # only the day that differs is compared
    assert (report.rewrites, report.inserts, report.deletes, report.unchanged) == (1, 0, 0, 2), report
    assert dict(there(job))[4] == "n4" and job.run("diff").findings[0]["code"] == "UNCHANGED"


def test_snapshots_take_changes_and_are_whole_at_any_time(place, spark, monkeypatch):
    place.save([(i, f"n{i * 7919 % 30011}", at(i % 50)) for i in range(20_000)])
    job = place()
    job.run("full")
    sink, names = job.sink, []
    want = dict(there(job))
    for turn in range(6):
        sink.write(spark.createDataFrame([(turn, f"t{turn}", None, "u"), (turn + 1, "later", None, "u"), (100 + turn, None, None, "d")], "id long, name string, update_time timestamp_ntz, _op string"))
        want |= {turn: f"t{turn}", turn + 1: "later"}
        want.pop(100 + turn, None)
        assert dict(there(job)) == want
        names.append(len(sink.folders()))
    assert names[0] == 2 and max(names) > 2  # changes are on top of the snapshot
    # a crash after the changes were written, before the pointer: the table is as before
    with monkeypatch.context() as m:
        m.setattr(sink, "_point", lambda _: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            sink.write(spark.createDataFrame([(0, "lost", None)], "id long, name string, update_time timestamp_ntz"))
    assert dict(there(job)) == want
    monkeypatch.setattr(type(sink), "MOST", 1)
    sink.write(spark.createDataFrame([(0, "end", None)], "id long, name string, update_time timestamp_ntz"))
    assert len(sink.folders()) == 1 and dict(there(job)) == want | {0: "end"}
    assert len([p for p in (place.path / "out").iterdir() if p.name.startswith(("snapshot", "changes"))]) <= 12


def test_state_is_replaced_at_once(spark, tmp_path, monkeypatch):
    store = FileState(spark, f"{tmp_path}/s")
    for i in range(3):
        store.put("j", "k", f"v{i}")
    assert store.get("j", "k") == "v2" and store.keys("j") == ["k"]


def test_long_reports_and_long_texts_in_databases(place, spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name}l;create=true"
    store = JdbcState(spark, url)
    report = RunReport(job="j", message="é" * 5000, findings=[{"level": "WARN", "code": "X", "message": "m" * 30_000}])
    store.add_run(report)
    store.add_run(report)
    assert [r.findings for r in store.runs("j")] == [report.findings]
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate('CREATE TABLE L ("id" BIGINT NOT NULL PRIMARY KEY, "name" VARCHAR(9000), "update_time" TIMESTAMP)')
    c.close()
    place.save([(1, "x" * 8000, at(1)), (2, "short", at(1))])
    job = place(target={"type": "jdbc", "url": url, "table": "L", "path": ""})
    assert job.run("full").status == "SUCCESS" and dict(there(job))[1] == "x" * 8000


def test_stream_loads_follow_the_frontend_to_a_backend(place):
    import http.server
    import threading

    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_PUT(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if not self.path.startswith("/be"):
                self.send_response(307)
                self.send_header("Location", f"http://127.0.0.1:{server.server_port}/be{self.path}")
                self.end_headers()
                return
            got.append((self.path, self.headers["Authorization"], self.headers["Label"], json.loads(body)))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"Status": "Success"}')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        place.save([(i, f"n{i}", at(1)) for i in range(5)])
        job = place(target={"type": "doris", "feHost": "127.0.0.1", "fePort": server.server_port, "database": "d", "table": "t", "user": "u", "password": "p", "path": ""}, runtime={"writeBatchSize": 2})
        report = job.run("full")
        assert (report.status, report.rows_written) == ("SUCCESS", 5), report.message
    finally:
        server.shutdown()
    assert sorted(r["id"] for *_, rows in got for r in rows) == [0, 1, 2, 3, 4] and len(got) >= 3
    assert all(path == "/be/api/d/t/_stream_load" and login == "Basic dTpw" and label.startswith("keelson-") for path, login, label, _ in got)


def test_a_new_target_type_can_be_registered(place):
    got = []

    class Mine(sinks.Sink):
        def write(self, rows):
            got.extend(rows.collect())

    place.save([(1, "a", at(1))])
    sinks.register("file", Mine)
    try:
        assert place(target={"type": "file", "path": "x"}).run("full").rows_written == 1 and got[0].id == 1
    finally:
        sinks.register("file", sinks.FileSink)


# ---------------------------------------------------------------- streaming


def test_polling_stream_merges_batches_and_goes_on(place, spark, tmp_path):
    spark.range(0, 25).select("id", F.concat(F.lit("n"), "id").alias("name")).coalesce(2).write.parquet(f"{tmp_path}/in")
    cfg = config.from_dict({"source": {"url": "x"}, "read": {"table": "t"}, "target": {"type": "parquet", "path": f"{tmp_path}/streamed", "primaryKey": ["id"]}}).validate()

    def drain():
        query = polling.merge_stream(polling.poll(spark, f"{tmp_path}/in", batch=10), cfg, f"{tmp_path}/cp")
        query.awaitTermination(120)
        return sorted(r.id for r in sinks.open_sink(spark, cfg).read().collect())

    assert drain() == list(range(25))
    spark.range(25, 32).select("id", F.lit("late").alias("name")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert drain() == drain() == list(range(32))


def test_polling_ids_that_are_sparse_negative_or_missing(spark, tmp_path):
    rows = [(-(10**17), "a"), (-1, "b"), (None, "c"), (10**18, "d")]
    spark.createDataFrame(rows, "id long, name string").coalesce(1).write.parquet(f"{tmp_path}/in")
    reader = polling.PollingReader({"path": f"{tmp_path}/in"}, spark.read.parquet(f"{tmp_path}/in").schema)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert end == {"id": 10**18} and len(parts) == 1
    assert sorted(x for b in reader.read(parts[0]) for x in b["name"].to_pylist()) == ["a", "b", "d"]
    assert reader.partitions(end, end) == []


# ---------------------------------------------------------------- command line


def test_command_line(place, spark, capsys):
    place.save([(i, "x", at(i)) for i in range(6)])
    values = {"name": "cli", "source": {"type": "parquet", "url": f"{place.path}/src"}, "read": {"table": "t.parquet"}, "target": {"type": "parquet", "path": f"{place.path}/out", "primaryKey": ["id"]}, "state": {"path": f"{place.path}/state"}, "splits": {"numPartitions": 3}}
    path = place.path / "job.json"
    path.write_text(json.dumps(values))
    run = lambda *a: cli.main([*a, "-c", str(path)], spark)
    assert run("run", "full") == 0 and run("state") == 0
    assert "2024-01-01T00:05:00|5" in capsys.readouterr().out
    assert run("plan") == 0
    plan = json.loads(capsys.readouterr().out)
    assert len(plan["shards"]) == 3
    assert run("exec-shard", "-s", "0", "--plan-id", plan["planId"]) == 0 and run("exec-shard", "0", "--plan-id", "stale") == 1
    assert run("incr") == 0 and run("check") == 0 and run("runs", "-n", "1") == 0 and run("reset") == 0
    assert run("run", "nothing") == 2 and cli.main(["run"], spark) == 2 and cli.main(["run", "-c", "/absent"], spark) == 2
    path.write_text(json.dumps(values | {"read": {"table": "absent.parquet"}}))
    assert run("run", "full") == 1
    task = cli.run_task({"configYaml": json.dumps(values), "configFile": "/absent", "mode": "whatever"}, spark)
    assert (task["mode"], task["status"]) == ("incremental", "SUCCESS")
