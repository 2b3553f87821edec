"""Checks of a run and before a run, as findings: level, code, message."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.config import JobConfig
from keelson.functions.values import OP, all_of, portable_hash, same
from keelson.operators.cursor import Watermark, lag_ms
from keelson.sources.stage import staged

SCHEMA = "level string, code string, message string"


@dataclass(frozen=True)
class Finding:
    level: str
    code: str
    message: str


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    message: str = ""


def row_count(read: int, written: int) -> Check:
    return Check("row_count", read >= 0 and written >= 0, f"read {read}, written {written}")


def target_count(written: int, deleted: int, there: int | None) -> Check:
    """Fails if more was written than the target has, unless something was deleted."""
    ok = there is None or there < 0 or deleted > 0 or written <= there
    return Check("target_count", ok, f"written {written}, deleted {deleted}, target {there}")


def watermark_lag(mark: Watermark, max_ms: int, now: datetime) -> Check | None:
    lag = lag_ms(mark, now)
    return None if max_ms <= 0 or lag is None else Check("watermark_lag", lag <= max_ms, f"{lag} ms behind, {max_ms} allowed")


def _wanted(n: int, fraction: float, limit: int) -> int:
    return min(limit, max(1, -int(-n * fraction // 1))) if n and fraction > 0 else 0


def _upserts(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(~F.lower(OP).isin("d", "delete"), F.lit(True))) if OP in df.columns else df


def stride_sample(df: DataFrame, keys: list[str], fraction: float, limit: int = 5_000, path: str = "") -> DataFrame:
    """``fraction`` of the rows, at least one and at most ``limit``, at even strides in key order; deletes are left out.

    Keys alone are put in order, over all tasks, and written once; a row's place is its task's first place and its own
    there. At most ``limit`` keys are then looked up.
    """
    rows = _upserts(df)
    ordered = rows.select(*keys).repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, *(F.col(k).asc_nulls_first() for k in keys)).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys))
    # the lower 33 bits count the rows of a task
    with staged(ordered.withColumn("_id", F.monotonically_increasing_id()), path) as placed:
        task, own = F.shiftright("_id", 33).alias("task"), F.col("_id").bitwiseAND((1 << 33) - 1)
        counts = sorted(tuple(r) for r in placed.groupBy(task).agg(F.count(F.lit(1))).collect())  # one number for each task
        n = sum(c for _, c in counts)
        want = _wanted(n, fraction, limit)
        if not want:
            return rows.limit(0)
        begins, before = [], 0
        for t, c in counts:
            begins.append((t, before))
            before += c
        first = F.broadcast(df.sparkSession.createDataFrame(begins, "task long, begin long"))
        picked = placed.join(first, F.shiftright("_id", 33) == F.col("task")).where((own + F.col("begin")) % max(1, n // want) == 0).orderBy("_id").limit(want).select(*keys).distinct().toArrow()
    picked = F.broadcast(df.sparkSession.createDataFrame(picked).alias("p"))  # at most ``limit`` keys
    return rows.alias("r").join(picked, [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left_semi").orderBy(*keys)


def random_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 0, limit: int = 5_000) -> DataFrame:
    """``fraction`` of the rows, at least one and at most ``limit``, by a hash of seed and key: the same rows in any engine. Deletes are left out."""
    rows = _upserts(df)
    want = _wanted(rows.count(), fraction, limit)
    return rows.orderBy(portable_hash(F.lit(seed), *map(F.col, keys)), *keys).limit(want)


def sample_mismatches(sample: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the sample that the target lacks or has differently: (keys, problem)."""
    names = [c for c in sample.columns if c in target.columns and c not in keys and c != OP]
    s, t = sample.alias("s"), target.withColumn("_there", F.lit(True)).alias("t")
    on = [same(F.col(f"s.{k}"), sample.schema[k].dataType, F.col(f"t.{k}"), target.schema[k].dataType) for k in keys]
    equal = all_of([same(F.col(f"s.{c}"), sample.schema[c].dataType, F.col(f"t.{c}"), target.schema[c].dataType) for c in names])
    problem = F.when(F.col("t._there").isNull(), "missing").when(~equal, "different")
    return s.join(t, on, "left").select(*(F.col(f"s.{k}").alias(k) for k in keys), problem.alias("problem")).where("problem is not null")


def verdict(checks: list[Check | None], fail: bool) -> str:
    bad = [c for c in checks if c is not None and not c.ok]
    return "SUCCESS" if not bad else "QUALITY_FAILED" if fail else "QUALITY_WARN"


# ---------------------------------------------------------------- before a run


def preflight(cfg: JobConfig, source: DataFrame | None, start: Watermark, indexed: set[str] | None = None, target_reachable: bool = True, error: str = "") -> list[Finding]:
    """What would go wrong. ``indexed``: columns with an index, None if the source cannot tell."""
    if source is None:
        return [Finding("ERROR", "SOURCE_UNREADABLE", error or "the source cannot be read")]
    have = {c.lower() for c in source.columns}
    if not have:
        return [Finding("ERROR", "NO_METADATA", "the source has no columns")]
    out: list[Finding] = []
    inc, roles = cfg.incremental, []
    timed = cfg.mode == "incremental" and inc.strategy in ("update_time", "update_time_id")
    if timed:
        roles.append(("incremental.column", inc.column))
    if cfg.mode == "incremental" and inc.strategy in ("id", "update_time_id"):
        roles.append(("incremental.idColumn", inc.id_column))
    if cfg.splits.num_partitions > 1:
        roles.append(("splits.column", cfg.splits.column))
    if cfg.delete_detect.mode == "soft_column":
        roles.append(("deleteDetect.softColumn", cfg.delete_detect.soft_column))
    if cfg.delete_detect.mode == "fingerprint" and cfg.delete_detect.fingerprint_column:
        roles.append(("deleteDetect.fingerprintColumn", cfg.delete_detect.fingerprint_column))
    roles += [("read.columns", c) for c in cfg.read.columns]
    for role, name in roles:
        if not name:
            out.append(Finding("ERROR", "COLUMN_UNSET", f"{role} is not set"))
        elif name.lower() not in have:
            out.append(Finding("ERROR", "COLUMN_MISSING", f"{role}: the source has no column {name}"))
    out += [Finding("ERROR", "PK_MISSING", f"the source has no key column {k}") for k in cfg.key if k.lower() not in have]
    if timed and start.ts is not None and inc.column.lower() in have:
        try:
            top = source.agg(F.max(F.col(inc.column).cast("timestamp_ntz"))).first()[0]
            if top is not None and top < start.ts - timedelta(minutes=1):
                out.append(Finding("ERROR" if cfg.quality.fail_on_watermark_regression else "WARN", "WATERMARK_REGRESSION", f"the source ends at {top}, the cursor is at {start.ts}"))
        except Exception as e:  # the check itself is not worth a run
            out.append(Finding("WARN", "WATERMARK_CHECK_FAILED", str(e).splitlines()[0]))
    if indexed is not None:
        for _, name in roles[: len(roles) - len(cfg.read.columns)]:
            if name.lower() in have and name.lower() not in indexed:
                out.append(Finding("ERROR" if cfg.quality.fail_on_missing_index else "WARN", "NO_INDEX", f"no index begins with {name}"))
    if not target_reachable:
        out.append(Finding("ERROR", "TARGET_UNREACHABLE", "the target cannot be reached"))
    if timed and not inc.lookback:
        out.append(Finding("WARN", "NO_OVERLAP", "rows that appear late are missed: incremental.overlap is zero"))
    return out
