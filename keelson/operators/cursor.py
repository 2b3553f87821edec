"""High-water cursors: predicates of an incremental pass, and the cursor that it reaches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.config import Incremental


@dataclass(frozen=True)
class Watermark:
    """An update time and an id; a later time wins, then a larger id, and any time beats none."""

    ts: datetime | None = None
    id: int | None = None

    @property
    def empty(self) -> bool:
        return self.ts is None and self.id is None

    def _rank(self) -> tuple:
        return (self.ts is not None, self.ts or datetime.min, self.id is not None, self.id or 0)

    def later(self, other: Watermark) -> Watermark:
        return self if self._rank() >= other._rank() else other


def _ts(value: datetime) -> Column:
    return F.lit(value.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def predicate(strategy: str, start: Watermark, ts: Column, id_: Column, lookback: timedelta = timedelta(0)) -> Column | None:
    """The rows after ``start``; None if all are.

    id: larger ids. update_time: at or after the time less the lookback. update_time_id: after the time less the
    lookback, or at the very time with a larger id (with all ids, if the cursor has none).
    """
    if strategy == "full" or start.empty:
        return None
    if strategy == "id" or start.ts is None:
        return id_ > start.id if start.id is not None and strategy != "update_time" else None
    low = _ts(start.ts - lookback)
    if strategy == "update_time":
        return ts >= low
    tie = ts == _ts(start.ts)
    return (ts > low) | (tie & (id_ > start.id) if start.id is not None else tie)


def incremental(df: DataFrame, inc: Incremental, start: Watermark) -> DataFrame:
    """The rows of one pass. With a cap, the first rows in cursor order: ties are broken by id, so passes neither skip nor repeat.

    With a cap the lookback is left out while it would return only what was read before: rows at or before the cursor
    do not count toward it.
    """
    ts, id_ = F.col(inc.column) if inc.column in df.columns else F.lit(None).cast("timestamp_ntz"), F.col(inc.id_column) if inc.id_column in df.columns else F.lit(None).cast("long")
    where = predicate(inc.strategy, start, ts, id_, inc.lookback)
    out = df if where is None else df.where(where)
    if inc.max_rows_per_run <= 0:
        return out
    order = {"id": [id_], "update_time": [ts, id_], "update_time_id": [ts, id_]}.get(inc.strategy, [id_])
    if where is None or inc.strategy == "id" or not inc.lookback:
        return out.orderBy(*order).limit(inc.max_rows_per_run)
    # rows that the lookback reads again come on top of the cap, or a full lookback window would stall the cursor
    fresh = predicate("update_time_id", start, ts, id_)
    new = out.where(fresh).orderBy(*order).limit(inc.max_rows_per_run)
    return out.where(F.coalesce(~fresh, F.lit(True))).unionByName(new)


def marks(df: DataFrame, inc: Incremental) -> list[Column]:
    """The aggregates mark_ts (text of fixed width) and mark_id: the cursor after these rows."""
    has_ts, has_id = inc.column in df.columns, inc.id_column in df.columns
    id_ = F.col(inc.id_column).cast("long") if has_id else F.lit(None).cast("long")
    if inc.strategy == "id" or not has_ts:
        return [F.max(F.lit(None).cast("string")).alias("mark_ts"), F.max(id_).alias("mark_id")]
    ts = F.col(inc.column).cast("timestamp_ntz")
    return [F.max(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("mark_ts"), F.max_by(id_, F.when(ts.isNotNull(), F.struct(ts, id_))).alias("mark_id")]


def mark(row: dict) -> Watermark:
    """The cursor of a row with mark_ts and mark_id."""
    ts = row["mark_ts"]
    return Watermark(datetime.fromisoformat(ts) if ts else None, row["mark_id"])


def reached(df: DataFrame, inc: Incremental) -> Watermark:
    """The cursor after these rows: one aggregate, combined on the map side."""
    return mark(df.agg(*marks(df, inc)).first().asDict())


def lag_ms(mark: Watermark, now: datetime) -> int | None:
    return None if mark.ts is None else max(0, (now - mark.ts) // timedelta(milliseconds=1))
