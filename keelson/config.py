"""Job configuration: YAML or JSON with camel-case keys; unknown keys are ignored.

``read`` may stand at the top or under ``source``; ``incremental``, ``splits`` and ``deleteDetect`` at the top or under ``read``.
"""

from __future__ import annotations

import dataclasses
import importlib
import json
import re
from dataclasses import dataclass, field
from datetime import timedelta
from pathlib import Path

from keelson.functions.durations import parse_duration

MODES = ("full", "incremental", "diff", "check")
STRATEGIES = ("full", "id", "update_time", "update_time_id")
SPLITS = ("auto", "range", "mod", "hash", "none")
DELETES = ("none", "soft_column", "pk_diff", "fingerprint")
#: Types of targets, with the keys that each needs; ``sinks.register`` adds to them. A type "module:Class" is imported.
SINKS: dict[str, tuple[str, ...]] = {
    "file": ("path",),
    "parquet": ("path",),
    "table": ("table",),
    "jdbc": ("url", "table"),
    "console": (),
    "kafka": ("brokers", "topic"),
    "doris": ("http_url", "database", "table"),
    "starrocks": ("http_url", "database", "table"),
    "paimon": ("warehouse", "table"),
}
# Other names of keys of a target.
ALIASES = {"bootstrapServers": "brokers", "paimonTable": "table"}


@dataclass
class Source:
    type: str = "mysql"
    url: str = ""
    user: str = ""
    password: str = ""
    pool_max: int = 8


@dataclass
class Read:
    mode: str = "table"
    table: str = ""
    query: str = ""
    columns: list[str] = field(default_factory=list)
    filter: str = ""
    primary_key: list[str] = field(default_factory=list)
    contract: dict = field(default_factory=dict)


@dataclass
class Incremental:
    strategy: str = "update_time_id"
    column: str = "update_time"
    id_column: str = "id"
    overlap: str = "PT5M"
    batch_rows: int = 50_000
    fetch_size: int = 5_000
    query_timeout_seconds: int = 0
    max_rows_per_run: int = 0

    @property
    def lookback(self) -> timedelta:
        return parse_duration(self.overlap)


@dataclass
class Splits:
    column: str = "id"
    num_partitions: int = 1
    mode: str = "sequential"  # parallel: several shards at a time
    strategy: str = "auto"


@dataclass
class DeleteDetect:
    mode: str = "none"
    soft_column: str = ""
    soft_true_values: list[str] = field(default_factory=list)
    fingerprint_column: str = ""


@dataclass
class Target:
    type: str = "file"
    path: str = ""
    format: str = "json"
    url: str = ""
    user: str = ""
    password: str = ""
    table: str = ""
    brokers: str = ""
    topic: str = ""
    acks: str = "all"
    http_url: str = ""
    fe_host: str = ""
    fe_port: int = 8030
    database: str = ""
    warehouse: str = ""
    catalog_db: str = "default"
    write_mode: str = "merge"
    primary_key: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


@dataclass
class State:
    type: str = "file"
    path: str = ".keelson/state"
    url: str = ""
    user: str = ""
    password: str = ""


@dataclass
class Runtime:
    extract_threads: int = 4
    write_batch_size: int = 1_000
    max_retries: int = 3
    retry_backoff_ms: int = 500
    retry_backoff_max_ms: int = 10_000
    retry_jitter_ms: int = 250
    max_rows_per_sec: int = 0
    max_concurrent_queries: int = 4
    report_path: str = ""
    stage_path: str = ""  # where rows wait between source and target; spark.checkpoint.dir if not set
    metrics_enabled: bool = True
    full_checkpoint: bool = True
    diff_window_rows: int = 5_000


@dataclass
class Quality:
    row_count_check: bool = True
    sample_hash_check: float = 0.0
    watermark_max_lag_ms: int = 0
    compare_row_content: bool = True
    auto_add_columns: bool = True
    preflight_enabled: bool = False
    fail_on_missing_index: bool = False
    fail_on_watermark_regression: bool = True
    fail_on_quality_mismatch: bool = False


@dataclass
class JobConfig:
    name: str = "keelson-job"
    mode: str = "incremental"
    source: Source = field(default_factory=Source)
    read: Read = field(default_factory=Read)
    incremental: Incremental = field(default_factory=Incremental)
    splits: Splits = field(default_factory=Splits)
    delete_detect: DeleteDetect = field(default_factory=DeleteDetect)
    target: Target = field(default_factory=Target)
    state: State = field(default_factory=State)
    runtime: Runtime = field(default_factory=Runtime)
    quality: Quality = field(default_factory=Quality)

    @property
    def key(self) -> list[str]:
        """The target's primary key, else the source's."""
        return self.target.primary_key or self.read.primary_key

    @property
    def queries_at_once(self) -> int:
        """How many shards may be read at a time."""
        r = self.runtime
        return 1 if self.splits.mode == "sequential" else max(1, min(r.extract_threads, r.max_concurrent_queries, self.source.pool_max))

    def validate(self) -> JobConfig:
        def need(ok: object, message: str) -> None:
            if not ok:
                raise ValueError(message)

        need(self.source.url, "source.url is required")
        need(self.mode in MODES, f"mode must be one of {MODES}")
        need(self.read.mode in ("table", "query"), "read.mode must be table or query")
        if self.read.mode == "table":
            need(self.read.table, "read.table is required in table mode")
        else:
            need(self.read.query, "read.query is required in query mode")
            need(self.key, "query mode needs a primary key")
            need(self.delete_detect.mode not in ("pk_diff", "fingerprint"), "query mode cannot find deletes by pk_diff or fingerprint")
        need(self.incremental.strategy in STRATEGIES, f"incremental.strategy must be one of {STRATEGIES}")
        need(self.splits.strategy in SPLITS, f"splits.strategy must be one of {SPLITS}")
        need(self.delete_detect.mode in DELETES, f"deleteDetect.mode must be one of {DELETES}")
        need(self.delete_detect.mode != "soft_column" or self.delete_detect.soft_column, "soft_column needs deleteDetect.softColumn")
        t = self.target
        need(t.type in SINKS or ":" in t.type, f"target.type must be one of {tuple(SINKS)}, or module:Class")
        need(t.write_mode in ("merge", "append"), "target.writeMode must be merge or append")
        for name in SINKS.get(t.type, ()):
            need(getattr(t, name), f"target.{_camel(name)} is required for {t.type}")
        need(t.type not in ("jdbc", "parquet") or t.write_mode != "merge" or t.primary_key, f"{t.type} merge needs target.primaryKey")
        need(self.splits.mode in ("parallel", "sequential"), "splits.mode must be parallel or sequential")
        need(self.splits.num_partitions >= 1, "splits.numPartitions must be at least 1")
        need(self.runtime.write_batch_size >= 1, "runtime.writeBatchSize must be at least 1")
        need(0 <= self.quality.sample_hash_check <= 1, "quality.sampleHashCheck must be between 0 and 1")
        self.incremental.lookback  # noqa: B018  raises if it cannot be read
        return self


def named(path: str) -> object:
    """What "module:name" names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _camel(name: str) -> str:
    return re.sub(r"_(.)", lambda m: m[1].upper(), name)


def _fill(kind: type, values: dict) -> object:
    out = kind()
    for f in dataclasses.fields(kind):
        value = (values or {}).get(_camel(f.name))
        if value is None:
            continue
        current = getattr(out, f.name)
        if dataclasses.is_dataclass(current):
            value = _fill(type(current), value)
        elif isinstance(current, list) and not isinstance(value, list):
            value = [x.strip() for x in str(value).split(",") if x.strip()]
        elif isinstance(current, str):
            value = str(value)
            if f.name in ("mode", "strategy", "type", "write_mode") and ":" not in value:
                value = value.lower()
        setattr(out, f.name, value)
    return out


def _flat(values: dict) -> dict:
    """Nested sections at the top, keys under their own names."""
    out = dict(values)
    source = dict(out.get("source") or {})
    out["read"] = read = dict(out.get("read") or source.pop("read", None) or {})
    out["source"] = source
    for section in ("incremental", "splits", "deleteDetect"):
        if section in read:
            out.setdefault(section, read.pop(section))
    target = dict(out.get("target") or {})
    for name, own in ALIASES.items():
        if target.get(name):
            target[own] = target[name]
    if target.get("feHost") and not target.get("httpUrl"):
        target["httpUrl"] = f"http://{target['feHost']}:{target.get('fePort') or 8030}"
    out["target"] = target
    return out


def from_dict(values: dict) -> JobConfig:
    return _fill(JobConfig, _flat(values))


def loads(text: str) -> JobConfig:
    """A configuration from YAML or JSON text, validated."""
    try:
        values = json.loads(text)
    except ValueError:
        import yaml

        values = yaml.safe_load(text)
    return from_dict(values or {}).validate()


def load(path: str) -> JobConfig:
    return loads(Path(path).read_text(encoding="utf-8"))
