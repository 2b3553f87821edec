"""Runs of a job: full, incremental, diff, check. Driver-side control around lazy plans.

Order of commits: target, then shard marks, then the cursor or fingerprint, then the report. A crash between any two
makes the next run read again what it wrote before, which a merging target absorbs.
"""

from __future__ import annotations

import contextlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelson.config import JobConfig
from keelson.functions.values import OP
from keelson.operators import cursor, diff, fingerprint, quality, splits
from keelson.operators.cursor import Watermark
from keelson.sources import scan, sinks
from keelson.sources.stage import staged
from keelson.state import RunReport, StateStore, mark_text, open_state


class PlanChanged(ValueError):
    """A shard was asked for under a plan that no longer holds."""


def with_retry(cfg: JobConfig, work: Callable[[], object], report: RunReport | None = None, sleep: Callable[[float], None] = time.sleep) -> object:
    """Up to maxRetries attempts, with doubling waits and some jitter. Spark's own task retries come before this."""
    r = cfg.runtime
    for attempt in range(max(1, r.max_retries)):
        try:
            return work()
        except (ValueError, TypeError):
            raise
        except Exception:
            if attempt + 1 >= max(1, r.max_retries):
                raise
            if report is not None:
                report.retries += 1
            sleep((min(r.retry_backoff_max_ms, r.retry_backoff_ms * 2**attempt) + random.uniform(0, r.retry_jitter_ms)) / 1000)
    return None


def throttle_seconds(rows: int, seconds: float, max_rows_per_sec: int) -> float:
    """How long to wait so that so many rows in so many seconds keep the rate."""
    return max(0.0, rows / max_rows_per_sec - seconds) if max_rows_per_sec > 0 else 0.0


class Job:
    def __init__(self, spark: SparkSession, cfg: JobConfig, state: StateStore | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)) -> None:
        self.spark, self.cfg, self.now = spark, cfg, now
        self.state = state or open_state(spark, cfg.state)
        self.sink = sinks.open_sink(spark, cfg)
        self._waited = None

    # ------------------------------------------------------------ shared

    def source(self, plan: splits.Plan | None = None) -> DataFrame:
        return scan.read(self.spark, self.cfg, plan)

    def plan(self) -> tuple[splits.Plan, str]:
        cfg = self.cfg
        can_hash = not scan.is_jdbc(cfg) or bool(scan.by_url(cfg.source.url).hashed)
        p = splits.plan(self.source(), cfg.splits.column, cfg.splits.num_partitions, cfg.splits.strategy, can_hash)
        return p, splits.plan_id(f"{cfg.source.url} {scan.from_clause(cfg)}", cfg.read.columns, cfg.read.filter, cfg.splits.column, p)

    def preflight(self, start: Watermark) -> list[quality.Finding]:
        try:
            # all columns, so that one that is missing is found by name
            df, error = scan.read(self.spark, replace(self.cfg, read=replace(self.cfg.read, columns=[]))), ""
        except Exception as e:
            df, error = None, str(e).splitlines()[0]
        return quality.preflight(self.cfg, df, start, scan.indexed_columns(self.spark, self.cfg), self.sink.reachable(), error)

    def run(self, mode: str | None = None) -> RunReport:
        """Never raises for a run that fails: its report says FAILED and why."""
        cfg, began = self.cfg, time.monotonic()
        mode = mode or cfg.mode
        report = RunReport(job=cfg.name, mode=mode, started_at=self.now().isoformat())
        try:
            start = Watermark() if mode == "full" else self.state.watermark(cfg.name)
            report.start = mark_text(start)
            if cfg.quality.preflight_enabled or mode == "check":
                report.findings = [vars(f) for f in self.preflight(start)]
                bad = [f for f in report.findings if f["level"] == "ERROR"]
                if bad and mode != "check":
                    raise ValueError("; ".join(f"{f['code']}: {f['message']}" for f in bad))
                if mode == "check":
                    report.status = "FAILED" if bad else "SUCCESS"
            if mode != "check":
                end = {"full": self._full, "incremental": self._incremental, "diff": self._diff}[mode](report, start)
                report.end = mark_text(end)
                self._check(report, end)
        except Exception as e:
            report.status, report.message = "FAILED", f"{type(e).__name__}: {str(e)[:1500]}"
        report.throttled_ms = self._waited.value if self._waited is not None else 0
        report.duration_ms = int((time.monotonic() - began) * 1000)
        report.rows_per_sec = report.rows_read * 1000 / max(1, report.duration_ms)
        report.finished_at = self.now().isoformat()
        self.state.add_run(report)
        if cfg.runtime.report_path and cfg.runtime.metrics_enabled:
            from keelson.state import FileState

            FileState(self.spark, cfg.runtime.report_path).add_run(report)
        return report

    def _write(self, rows: DataFrame, report: RunReport, waiting: bool = False) -> tuple[int, int, Watermark]:
        """Write rows that are read once: (rows, deletes, cursor). Counts and cursor come from that pass.

        A target that goes over the rows once gets them as they come; for others they wait in shared files (they do
        already with ``waiting``), so that neither a second look nor a lost executor reads a moving source again.
        """
        deletes = F.count(F.when(F.coalesce(F.lower(OP).isin("d", "delete"), F.lit(False)), 1)) if OP in rows.columns else F.count(F.lit(None))
        said = [F.count(F.lit(1)).alias("n"), deletes.alias("gone"), *cursor.marks(rows, self.cfg.incremental)]
        rows = rows if waiting else self._paced(rows, report)
        if self.sink.one_pass:

            def attempt() -> dict:
                seen = Observation()
                self.sink.write(rows.observe(seen, *said))
                return seen.get

            found = with_retry(self.cfg, attempt, report)
        else:
            with contextlib.nullcontext(rows) if waiting else staged(rows, self.cfg.runtime.stage_path) as own:
                found = own.agg(*said).first().asDict()
                if found["n"]:
                    with_retry(self.cfg, lambda: self.sink.write(own), report)
        report.rows_written += found["n"]
        return found["n"], found["gone"], cursor.mark(found)

    def _paced(self, rows: DataFrame, report: RunReport) -> DataFrame:
        """The rows at maxRowsPerSec at most, while they are read: each task waits before it asks the source for more."""
        rate, context = self.cfg.runtime.max_rows_per_sec, self.spark.sparkContext
        if rate <= 0:
            return rows
        own = max(1.0, rate / max(1, min(rows.rdd.getNumPartitions(), context.defaultParallelism)))
        waited = self._waited = context.accumulator(0)

        def slowly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            began, n = time.monotonic(), 0
            for batch in batches:
                step = max(1, int(own))  # what a second allows
                for lo in range(0, len(batch), step):
                    part = batch.slice(lo, step)
                    n += len(part)
                    wait = throttle_seconds(n, time.monotonic() - began, own)
                    time.sleep(wait)
                    waited.add(int(wait * 1000))
                    yield part

        return rows.mapInArrow(slowly, rows.schema)

    # ------------------------------------------------------------ modes

    def _full(self, report: RunReport, start: Watermark) -> Watermark:
        """All shards; with checkpoints each is written and marked on its own, and a later run skips what is marked."""
        cfg = self.cfg
        plan, plan_id = self.plan()
        report.shards = len(plan.shards)
        report.findings += [{"level": "WARN", "code": "SPLIT", "message": w} for w in plan.warnings]
        if not cfg.runtime.full_checkpoint or len(plan.shards) == 1:
            n, _, mark = self._write(self.source(plan), report)
            report.rows_read = n
            self.state.save_watermark(cfg.name, mark)
            return mark
        self.state.clear_progress(cfg.name, keep_plan=plan_id)
        done = self.state.done(cfg.name, plan_id)
        report.shards_skipped = len(done)
        mark = Watermark()
        for m in done.values():
            mark = mark.later(m)
        left = [i for i in range(len(plan.shards)) if i not in done]
        # files are read whole for every remainder: all of those in one pass
        size = len(left) if plan.mode in ("mod", "hash") and not scan.is_jdbc(cfg) else cfg.queries_at_once
        for at in range(0, len(left), max(1, size)):
            n, own = self._shards(plan, plan_id, left[at : at + size], report)
            report.rows_read += n
            mark = mark.later(own)
        self.state.save_watermark(cfg.name, mark)
        self.state.clear_progress(cfg.name)
        return mark

    def _shards(self, plan: splits.Plan, plan_id: str, numbers: list[int], report: RunReport) -> tuple[int, Watermark]:
        """Some shards in one job, each by its own query, and then their marks."""
        n, _, mark = self._write(scan.read(self.spark, self.cfg, shards=[plan.shards[i] for i in numbers]), report)
        for i in numbers:
            self.state.mark_done(self.cfg.name, plan_id, i, mark)
        return n, mark

    def run_shard(self, i: int, expected_plan: str = "") -> dict:
        """One shard of a full run, for an outside scheduler; skipped if it is marked already."""
        plan, plan_id = self.plan()
        if expected_plan and expected_plan != plan_id:
            raise PlanChanged(f"the plan is {plan_id} now, not {expected_plan}")
        if not 0 <= i < len(plan.shards):
            raise ValueError(f"there are {len(plan.shards)} shards")
        if i in self.state.done(self.cfg.name, plan_id):
            return {"rows": 0, "skipped": True, "shard": plan.shards[i].label, "plan": plan_id}
        n, mark = self._shards(plan, plan_id, [i], RunReport())
        return {"rows": n, "skipped": False, "shard": plan.shards[i].label, "plan": plan_id, "watermark": mark_text(mark)}

    def _incremental(self, report: RunReport, start: Watermark) -> Watermark:
        rows = cursor.incremental(self.source(), self.cfg.incremental, start)
        report.rows_read, _, mark = self._write(rows, report)
        end = start.later(mark)  # never back
        self.state.save_watermark(self.cfg.name, end)
        return end

    def _diff(self, report: RunReport, start: Watermark) -> Watermark:
        cfg, how = self.cfg, self.cfg.delete_detect
        if how.mode == "none":
            report.findings.append({"level": "INFO", "code": "NO_DELETE_DETECT", "message": "deleteDetect.mode is none"})
            return start
        source = self.source()
        if how.mode == "soft_column":
            report.rows_read, report.deletes, _ = self._write(diff.soft_deletes(source, how.soft_column, how.soft_true_values), report)
            return start
        if not self.sink.readable:
            raise ValueError(f"a {cfg.target.type} target cannot be read back: {how.mode} would take it for empty")
        target = self.sink.read()
        if target is None:
            target = self.spark.createDataFrame([], source.schema)
        keys = self.cfg.key or [cfg.incremental.id_column]
        names = {c.lower(): c for c in target.columns}
        target = target.select(*(F.col(names[c.lower()]).alias(c) if c.lower() in names else F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns))
        if how.mode == "fingerprint":
            # both sides, by partition: what has drifted on either is found
            column = how.fingerprint_column
            now, there = (fingerprint.by_partition(x, fingerprint.partition_of(x, column)) for x in (source, target))
            if not fingerprint.changed(now, there).limit(1).count():
                report.findings.append({"level": "INFO", "code": "UNCHANGED", "message": "source and target have the same fingerprints"})
                return start
            source, target = fingerprint.moved(source, target, column)
        if cfg.quality.preflight_enabled:
            for side, rows in (("source", source), ("target", target)):
                if diff.repeated(rows, keys).limit(1).count():
                    report.findings.append({"level": "WARN", "code": "KEY_REPEATED", "message": f"rows of the {side} share a key: they are paired with each of the other side"})
        seen = Observation()
        counts = {name: F.count(F.when(F.col(OP) == op, 1)).alias(name) for op, name in (("i", "inserts"), ("u", "rewrites"), ("d", "deletes"), ("=", "unchanged"))}
        changes = diff.classify(source, target, keys, cfg.quality.compare_row_content).observe(seen, *counts.values()).where(F.col(OP) != "=")
        with staged(changes, cfg.runtime.stage_path) as waiting:
            found = seen.get
            report.inserts, report.rewrites, report.deletes, report.unchanged = (found[name] for name in counts)
            report.rows_read = found["inserts"] + found["rewrites"] + found["unchanged"]
            self._write(waiting, report, waiting=True)
        if how.mode == "fingerprint":  # only after what it led to is in the target
            self.state.put(cfg.name, "fingerprint", fingerprint.text(fingerprint.table(self.source()).first()))
        return start

    # ------------------------------------------------------------ checks

    def _check(self, report: RunReport, end: Watermark) -> None:
        q, checks = self.cfg.quality, []
        if q.row_count_check:
            checks.append(quality.row_count(report.rows_read, report.rows_written))
            if self.sink.readable and report.mode == "full":
                there = self.sink.read()
                checks.append(quality.target_count(report.rows_written, report.deletes, None if there is None else there.count()))
        report.lag_ms = cursor.lag_ms(end, self.now())
        checks.append(quality.watermark_lag(end, q.watermark_max_lag_ms, self.now()))
        if q.sample_hash_check > 0 and self.sink.readable and self.cfg.key and report.mode == "full":
            there = self.sink.read()
            if there is not None:
                names = {c.lower(): c for c in there.columns}
                there = there.select(*(F.col(names[c.lower()]).alias(c) for c in self.source().columns if c.lower() in names))
                bad = quality.sample_mismatches(quality.stride_sample(self.source(), self.cfg.key, q.sample_hash_check, path=self.cfg.runtime.stage_path), there, self.cfg.key).count()
                checks.append(quality.Check("sample_hash", bad == 0, f"{bad} rows of the sample are missing or different"))
        report.checks = [vars(c) for c in checks if c is not None]
        report.status = quality.verdict(checks, q.fail_on_quality_mismatch)
