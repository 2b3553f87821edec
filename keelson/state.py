"""State of jobs: cursors, shard progress, fingerprints, run reports. On any file system that Spark reaches, or in a database."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession

from keelson.config import named
from keelson.operators.cursor import Watermark


@dataclass
class RunReport:
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    job: str = ""
    mode: str = ""
    status: str = "RUNNING"
    started_at: str = ""
    finished_at: str = ""
    duration_ms: int = 0
    rows_read: int = 0
    rows_written: int = 0
    inserts: int = 0
    rewrites: int = 0
    deletes: int = 0
    unchanged: int = 0
    shards: int = 0
    shards_skipped: int = 0
    throttled_ms: int = 0
    retries: int = 0
    start: str = ""
    end: str = ""
    lag_ms: int | None = None
    rows_per_sec: float = 0.0
    message: str = ""
    findings: list = field(default_factory=list)
    checks: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> RunReport | None:
        """None for a line that cannot be read."""
        try:
            values = json.loads(text)
            return RunReport(**{k: v for k, v in values.items() if k in RunReport.__dataclass_fields__})
        except (ValueError, TypeError, AttributeError):
            return None


def mark_text(mark: Watermark) -> str:
    return "" if mark.empty else f"{'' if mark.ts is None else mark.ts.isoformat()}|{'' if mark.id is None else mark.id}"


def mark_of(text: str | None) -> Watermark:
    ts, _, id_ = (text or "").partition("|")
    return Watermark(datetime.fromisoformat(ts) if ts else None, int(id_) if id_ else None)


class StateStore:
    """What a store has to do: keep small texts by job and key, atomically, and run reports in order."""

    def get(self, job: str, key: str) -> str | None:
        raise NotImplementedError

    def put(self, job: str, key: str, value: str | None) -> None:
        raise NotImplementedError

    def keys(self, job: str) -> list[str]:
        raise NotImplementedError

    def add_run(self, report: RunReport) -> None:
        raise NotImplementedError

    def runs(self, job: str | None = None, limit: int = 0) -> list[RunReport]:
        raise NotImplementedError

    # cursors

    def watermark(self, job: str) -> Watermark:
        return mark_of(self.get(job, "watermark"))

    def save_watermark(self, job: str, mark: Watermark) -> None:
        self.put(job, "watermark", mark_text(mark))

    # progress of full runs: one key for each finished shard, so writers do not step on each other

    def done(self, job: str, plan_id: str) -> dict[int, Watermark]:
        head = f"full-{plan_id}-"
        return {int(k[len(head) :]): mark_of(self.get(job, k)) for k in self.keys(job) if k.startswith(head)}

    def mark_done(self, job: str, plan_id: str, shard: int, mark: Watermark) -> None:
        self.put(job, f"full-{plan_id}-{shard}", mark_text(mark))

    def clear_progress(self, job: str, keep_plan: str = "") -> None:
        for k in self.keys(job):
            if k.startswith("full-") and not (keep_plan and k.startswith(f"full-{keep_plan}-")):
                self.put(job, k, None)

    def reset(self, job: str) -> None:
        self.put(job, "watermark", None)
        self.clear_progress(job)


class FileState(StateStore):
    """One small file for each key, replaced by a rename; reports are files named by time. Uses Hadoop's file systems from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.root = path.rstrip("/")

    def _path(self, *parts: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self) -> object:
        return self._path().getFileSystem(self._conf)

    def _read(self, path: object) -> str | None:
        fs = self._fs()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path: object, text: str) -> None:
        fs = self._fs()
        fs.mkdirs(path.getParent())
        temp = self._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._replace(temp, path)

    def _replace(self, temp: object, path: object) -> None:
        """Rename over what is there, at once; a file system without that has the old value deleted first."""
        hadoop = self._jvm.org.apache.hadoop.fs
        try:
            how = self._gateway.new_array(hadoop.Options.Rename, 1)
            how[0] = hadoop.Options.Rename.OVERWRITE
            hadoop.FileContext.getFileContext(path.toUri(), self._conf).rename(temp, path, how)
        except Exception as e:
            if "UnsupportedFileSystem" not in str(e):
                raise
            fs = self._fs()
            fs.delete(path, False)
            if not fs.rename(temp, path):
                raise OSError(f"state was not written: {path}") from e

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(n for s in fs.listStatus(path) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(path) else []

    def get(self, job: str, key: str) -> str | None:
        return self._read(self._path("jobs", job, key)) or None

    def put(self, job: str, key: str, value: str | None) -> None:
        if value:
            self._write(self._path("jobs", job, key), value)
        else:
            self._fs().delete(self._path("jobs", job, key), False)

    def keys(self, job: str) -> list[str]:
        return self._names("jobs", job)

    def add_run(self, report: RunReport) -> None:
        stamp = (report.started_at or "0").replace(":", "").replace("-", "")
        self._write(self._path("runs", f"{stamp}-{report.run_id}.json"), report.to_json())

    def runs(self, job: str | None = None, limit: int = 0) -> list[RunReport]:
        """Newest first; all if the limit is not above zero."""
        out: list[RunReport] = []
        for name in reversed(self._names("runs")):
            report = RunReport.from_json(self._read(self._path("runs", name)) or "")
            if report is not None and job in (None, report.job):
                out.append(report)
                if 0 < limit <= len(out):
                    break
        return out


class JdbcState(StateStore):
    """The same in two tables of a database, by one connection for each call, with explicit transactions."""

    def __init__(self, spark: SparkSession, url: str, user: str = "", password: str = "") -> None:
        self._manager, self._args = spark._jvm.java.sql.DriverManager, (url, user, password)
        for sql in ("CREATE TABLE keelson_state (job_id VARCHAR(128) NOT NULL, meta_key VARCHAR(128) NOT NULL, meta_value VARCHAR(2000), PRIMARY KEY (job_id, meta_key))", "CREATE TABLE keelson_run (run_id VARCHAR(64) NOT NULL, part INT NOT NULL, job_id VARCHAR(128), started_at VARCHAR(40), report VARCHAR(4000), PRIMARY KEY (run_id, part))"):
            try:
                self._run([(sql, [])])
            except Exception as e:
                if not any(word in str(e).lower() for word in ("exist", "already")):
                    raise

    def _run(self, statements: list[tuple[str, list]], columns: int = 0) -> list[list]:
        c = self._manager.getConnection(*self._args)
        try:
            c.setAutoCommit(False)
            out: list[list] = []
            for sql, args in statements:
                s = c.prepareStatement(sql)
                for i, a in enumerate(args, 1):
                    s.setString(i, a)
                if columns:
                    rows = s.executeQuery()
                    while rows.next():
                        out.append([rows.getString(i) for i in range(1, columns + 1)])
                else:
                    s.executeUpdate()
                s.close()
            c.commit()
            return out
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def get(self, job: str, key: str) -> str | None:
        rows = self._run([("SELECT meta_value FROM keelson_state WHERE job_id = ? AND meta_key = ?", [job, key])], 1)
        return rows[0][0] or None if rows else None

    def put(self, job: str, key: str, value: str | None) -> None:
        todo = [("DELETE FROM keelson_state WHERE job_id = ? AND meta_key = ?", [job, key])]
        self._run([*todo, ("INSERT INTO keelson_state VALUES (?, ?, ?)", [job, key, value])] if value else todo)

    def keys(self, job: str) -> list[str]:
        return [r[0] for r in self._run([("SELECT meta_key FROM keelson_state WHERE job_id = ? ORDER BY meta_key", [job])], 1)]

    def add_run(self, report: RunReport) -> None:
        """Reports are kept whole, in parts."""
        text = report.to_json()
        parts = [text[i : i + PART] for i in range(0, len(text), PART)]
        rows = [("INSERT INTO keelson_run VALUES (?, ?, ?, ?, ?)", [report.run_id, str(i), report.job, report.started_at, p]) for i, p in enumerate(parts)]
        self._run([("DELETE FROM keelson_run WHERE run_id = ?", [report.run_id]), *rows])

    def runs(self, job: str | None = None, limit: int = 0) -> list[RunReport]:
        order = "ORDER BY started_at DESC, run_id DESC, part"
        rows = self._run([(f"SELECT run_id, report FROM keelson_run WHERE job_id = ? {order}", [job]) if job else (f"SELECT run_id, report FROM keelson_run {order}", [])], 2)
        texts: dict[str, str] = {}
        for run, part in rows:
            texts[run] = texts.get(run, "") + part
        found = [r for r in map(RunReport.from_json, texts.values()) if r is not None]
        return found[:limit] if limit > 0 else found


#: Characters of a report in one row of a database.
PART = 1000

_TYPES: dict[str, Callable[[SparkSession, object], StateStore]] = {
    "file": lambda spark, cfg: FileState(spark, cfg.path),
    "jdbc": lambda spark, cfg: JdbcState(spark, cfg.url, cfg.user, cfg.password),
}


def register(name: str, make: Callable[[SparkSession, object], StateStore]) -> None:
    _TYPES[name] = make


def open_state(spark: SparkSession, cfg: object) -> StateStore:
    """The configured store; a type "module:Class" is imported and made with (spark, cfg)."""
    make = _TYPES.get(cfg.type) or (named(cfg.type) if ":" in cfg.type else None)
    if make is None:
        raise ValueError(f"state.type must be one of {tuple(_TYPES)}, or module:Class")
    return make(spark, cfg)
