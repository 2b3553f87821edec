"""Command line: run full|incremental|diff, check, state, runs, reset, plan, exec-shard. Exit 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from keelson import config
from keelson.plans.runner import Job
from keelson.state import mark_text

_RUN = {"full": "full", "incremental": "incremental", "incr": "incremental", "diff": "diff"}


def session() -> SparkSession:
    return SparkSession.builder.appName("keelson").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("keelson", description=__doc__)
    parser.add_argument("command", choices=["run", *_RUN, "check", "validate", "state", "runs", "reset", "plan", "exec-shard"])
    parser.add_argument("what", nargs="?", help="for run: full, incremental or diff; for exec-shard: its number")
    parser.add_argument("-c", "--config", required=True)
    parser.add_argument("-n", "--limit", type=int, default=20)
    parser.add_argument("-s", "--shard", type=int)
    parser.add_argument("--plan-id", default="")
    try:
        a = parser.parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        cfg = config.load(a.config)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    job = Job(spark or session(), cfg)
    command, what = a.command, a.what
    if command in _RUN:
        command, what = "run", command
    if command == "run":
        if what is not None and what not in _RUN:
            print(f"no mode {what}", file=sys.stderr)
            return 2
        report = job.run(_RUN[what] if what else None)
        print(json.dumps(asdict(report), indent=1))
        return 1 if report.status in ("FAILED", "QUALITY_FAILED") else 0
    if command in ("check", "validate"):
        report = job.run("check")
        for f in report.findings:
            print(f"{f['level']} {f['code']} {f['message']}")
        print(report.status)
        return 1 if report.status == "FAILED" else 0
    if command == "state":
        print(mark_text(job.state.watermark(cfg.name)) or "empty")
    elif command == "runs":
        for r in job.state.runs(cfg.name, a.limit):
            print(f"{r.started_at} {r.mode} {r.status} read={r.rows_read} written={r.rows_written} {r.message}".rstrip())
    elif command == "reset":
        job.state.reset(cfg.name)
        print("reset")
    elif command == "plan":
        plan, plan_id = job.plan()
        print(json.dumps({"planId": plan_id, "mode": plan.mode, "warnings": plan.warnings, "shards": [s.label for s in plan.shards]}))
    else:
        number = a.shard if a.shard is not None else what
        if number is None:
            print("exec-shard needs a shard's number", file=sys.stderr)
            return 2
        try:
            print(json.dumps(job.run_shard(int(number), a.plan_id)))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    return 0


def run_task(params: dict, spark: SparkSession | None = None) -> dict:
    """For schedulers: configYaml (wins) or configFile, and mode (an unknown one is incremental)."""
    text = (params.get("configYaml") or "").strip()
    cfg = config.loads(text) if text else config.load(params["configFile"])
    return asdict(Job(spark or session(), cfg).run(_RUN.get(str(params.get("mode", "")).lower(), "incremental")))


if __name__ == "__main__":
    sys.exit(main())
