"""Splitting a table into shards that together hold every row once."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.values import portable_hash

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


@dataclass(frozen=True)
class Shard:
    """kind: all, range (lo <= c < hi; None is open), mod or hash (remainder of n). NULL keys belong to the first shard."""

    kind: str = "all"
    column: str = ""
    lo: int | None = None
    hi: int | None = None
    n: int = 1
    remainder: int = 0

    @property
    def label(self) -> str:
        if self.kind == "range":
            return f"[{'-inf' if self.lo is None else self.lo},{'inf' if self.hi is None else self.hi})"
        return {"all": "all", "mod": f"mod {self.n}={self.remainder}", "hash": f"hash(mod {self.n})={self.remainder}"}[self.kind]

    def predicate(self) -> Column:
        c = F.col(self.column) if self.column else None
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "range":
            low = F.lit(True) if self.lo is None else c >= self.lo
            high = F.lit(True) if self.hi is None else c < self.hi
            return low & high if self.lo is not None else high | c.isNull()
        own = F.pmod(c if self.kind == "mod" else portable_hash(c), F.lit(self.n)) == self.remainder
        return own | c.isNull() if self.remainder == 0 and self.kind == "mod" else own

    def sql(self, quoted: str, mod: str = "MOD({c}, {n})", hashed: str | None = None) -> str:
        """The predicate as SQL of a source database; ``mod`` and ``hashed`` are its ways to say a remainder."""
        if self.kind == "all":
            return "1 = 1"
        if self.kind == "range":
            low = "" if self.lo is None else f"{quoted} >= {self.lo}"
            high = "" if self.hi is None else f"{quoted} < {self.hi}"
            both = " AND ".join(x for x in (low, high) if x) or "1 = 1"
            return f"({both} OR {quoted} IS NULL)" if self.lo is None else both
        if self.kind == "hash":
            if hashed is None:
                raise ValueError("this database has no hash to split by")
            own = f"{hashed.format(c=quoted, n=self.n)} = {self.remainder}"
        else:
            # the remainder of a negative number is negative in SQL
            inner = mod.format(c=quoted, n=self.n)
            own = f"{mod.format(c=f'({inner} + {self.n})', n=self.n)} = {self.remainder}"
        return f"({own} OR {quoted} IS NULL)" if self.remainder == 0 else own


@dataclass(frozen=True)
class Plan:
    shards: tuple[Shard, ...]
    mode: str
    warnings: tuple[str, ...] = ()


def probe(df: DataFrame, column: str) -> tuple[int | None, int | None]:
    """Smallest and largest key, by one aggregate."""
    row = df.agg(F.min(column), F.max(column)).first()
    return (None, None) if row[0] is None else (int(row[0]), int(row[1]))


def cut(column: str, low: int, high: int, parts: int) -> tuple[Shard, ...]:
    """Ranges of equal width; the first is open below (and has the NULLs), the last above, so rows that come meanwhile are not lost."""
    step = max(1, -(-(high - low + 1) // parts))
    edges = [low + i * step for i in range(1, parts) if low + i * step <= high]
    bounds = [None, *edges, None]
    return tuple(Shard("range", column, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def plan(df: DataFrame, column: str, parts: int, strategy: str = "auto", can_hash: bool = True) -> Plan:
    """Shards for a table. auto: ranges over a whole-number key, a hash over others; what cannot be split is one shard, with a warning."""
    whole = Plan((Shard(),), "none")
    if parts <= 1 or not column or strategy == "none":
        return whole
    if column not in df.columns:
        return Plan(whole.shards, "none", (f"no column {column} to split by",))
    numeric = isinstance(df.schema[column].dataType, _NUMERIC)
    if strategy == "mod" and numeric:
        return Plan(tuple(Shard("mod", column, n=parts, remainder=r) for r in range(parts)), "mod")
    if strategy in ("auto", "range") and numeric:
        low, high = probe(df, column)
        return Plan((Shard("range", column),), "range") if low is None else Plan(cut(column, low, high, parts), "range")
    if can_hash:
        said = () if strategy in ("auto", "hash") else (f"{column} is not a whole number: split by hash",)
        return Plan(tuple(Shard("hash", column, n=parts, remainder=r) for r in range(parts)), "hash", said)
    return Plan(whole.shards, "none", (f"{column} cannot be split here: one shard",))


def plan_id(source: str, columns: list[str], where: str, column: str, plan_: Plan) -> str:
    """Changes whenever shards stand for other rows."""
    body = json.dumps([source, columns, where, column, plan_.mode, [s.label for s in plan_.shards]])
    return hashlib.sha256(body.encode()).hexdigest()[:24]


def tagged(df: DataFrame, plan_: Plan) -> DataFrame:
    """df with the number of each row's shard: one pass, for counts and checks."""
    number = F.lit(None).cast("int")
    for i, shard in reversed(list(enumerate(plan_.shards))):
        number = F.when(shard.predicate(), F.lit(i)).otherwise(number)
    return df.withColumn("shard", number)
