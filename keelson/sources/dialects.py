"""SQL of source and target databases: what Spark's JDBC connector has no words for."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from keelson.config import named
from keelson.operators.splits import Shard


@dataclass(frozen=True)
class Dialect:
    """Standard SQL; the fields say where a database differs. Templates name c (column) and n."""

    name: str = "standard"
    quotes: tuple[str, str] = ('"', '"')
    limit_at: str = "end"  # end: LIMIT n; fetch: FETCH FIRST n ROWS ONLY; top: SELECT TOP (n)
    mod: str = "MOD({c}, {n})"
    hashed: str | None = None
    upsert_by: str = ""  # duplicate, conflict, merge_dual, merge, merge_key
    add_column: str = "ALTER TABLE {table} ADD COLUMN {column} {kind}"
    stamp: str = "'{0}'"
    options: tuple[tuple[str, str], ...] = ()

    def quote(self, name: str) -> str:
        """A name, or each part of a dotted one, once in quotes however often this is called."""
        a, b = self.quotes
        parts = [p if a and p.startswith(a) and p.endswith(b) else f"{a}{p}{b}" for p in name.split(".")]
        return ".".join(parts)

    def select(self, columns: list[str], source: str, where: list[str] = (), order: list[str] = (), limit: int = 0) -> str:
        names = ", ".join(map(self.quote, columns)) or "*"
        top = f"TOP ({limit}) " if limit and self.limit_at == "top" else ""
        sql = f"SELECT {top}{names} FROM {source}"
        if kept := [w for w in where if w and w.strip()]:
            sql += " WHERE " + " AND ".join(f"({w})" for w in kept)
        if order:
            sql += " ORDER BY " + ", ".join(map(self.quote, order))
        if limit and self.limit_at != "top":
            sql += f" LIMIT {limit}" if self.limit_at == "end" else f" FETCH FIRST {limit} ROWS ONLY"
        return sql

    def shard(self, s: Shard) -> str:
        return s.sql(self.quote(s.column) if s.column else "", self.mod, self.hashed)

    def timestamp(self, value: datetime) -> str:
        return self.stamp.format(value.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds"))

    def insert(self, table: str, columns: list[str]) -> str:
        return f"INSERT INTO {table} ({', '.join(map(self.quote, columns))}) VALUES ({', '.join('?' * len(columns))})"

    def delete(self, table: str, keys: list[str]) -> str:
        return f"DELETE FROM {table} WHERE " + " AND ".join(f"{self.quote(k)} = ?" for k in keys)

    def add(self, table: str, column: str, kind: str) -> str:
        return self.add_column.format(table=table, column=self.quote(column), kind=kind)

    def upsert(self, table: str, columns: list[str], keys: list[str]) -> str:
        """One row's upsert by parameters. Key columns are never assigned; a row of keys only changes nothing that is there."""
        q, rest = self.quote, [c for c in columns if c not in keys]
        rows = f"({', '.join(map(q, columns))}) VALUES ({', '.join('?' * len(columns))})"
        if self.upsert_by == "duplicate":
            sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest) or f"{q(keys[0])} = {q(keys[0])}"
            return f"INSERT INTO {table} {rows} ON DUPLICATE KEY UPDATE {sets}"
        if self.upsert_by == "conflict":
            sets = "UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest) if rest else "NOTHING"
            return f"INSERT INTO {table} {rows} ON CONFLICT ({', '.join(map(q, keys))}) DO {sets}"
        if self.upsert_by == "merge_key":
            return f"MERGE INTO {table} ({', '.join(map(q, columns))}) KEY ({', '.join(map(q, keys))}) VALUES ({', '.join('?' * len(columns))})"
        if self.upsert_by in ("merge", "merge_dual"):
            one = ", ".join(f"? AS {q(c)}" for c in columns)
            source = f"(SELECT {one}{' FROM dual' if self.upsert_by == 'merge_dual' else ''}) s"
            return self._merge(table, source, columns, keys, rest) + (";" if self.upsert_by == "merge" else "")
        raise ValueError(f"{self.name} has no upsert")

    def _merge(self, table: str, source: str, columns: list[str], keys: list[str], rest: list[str]) -> str:
        q = self.quote
        sql = f"MERGE INTO {table} t USING {source} ON ({' AND '.join(f't.{q(k)} = s.{q(k)}' for k in keys)})"
        if rest:
            left = "" if self.name in ("derby", "postgres") else "t."
            sql += " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{left}{q(c)} = s.{q(c)}" for c in rest)
        return sql + f" WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"

    def _exists(self, table: str, staged: str, keys: list[str]) -> str:
        return f"EXISTS (SELECT 1 FROM {staged} s WHERE " + " AND ".join(f"{table}.{self.quote(k)} = s.{self.quote(k)}" for k in keys) + ")"

    def delete_staged(self, table: str, staged: str, keys: list[str]) -> str:
        """Delete the rows whose keys a staging table has."""
        return f"DELETE FROM {table} WHERE {self._exists(table, staged, keys)}"

    def upsert_staged(self, table: str, staged: str, columns: list[str], keys: list[str]) -> list[str]:
        """Statements that bring a staging table's rows into the target; a database without an upsert deletes and inserts."""
        q, rest, names = self.quote, [c for c in columns if c not in keys], ", ".join(map(self.quote, columns))
        if self.upsert_by in ("merge", "merge_derby", "merge_dual"):
            return [self._merge(table, f"{staged} s", columns, keys, rest) + (";" if self.upsert_by == "merge" else "")]
        pick = f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} s"
        if self.upsert_by == "duplicate":
            return [pick + " ON DUPLICATE KEY UPDATE " + (", ".join(f"{q(c)} = VALUES({q(c)})" for c in rest) or f"{q(keys[0])} = VALUES({q(keys[0])})")]
        if self.upsert_by == "conflict":
            sets = "UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest) if rest else "NOTHING"
            return [f"{pick} ON CONFLICT ({', '.join(map(q, keys))}) DO {sets}"]
        if self.upsert_by == "merge_key":
            return [f"MERGE INTO {table} ({names}) KEY ({', '.join(map(q, keys))}) SELECT {names} FROM {staged} s"]
        return [self.delete_staged(table, staged, keys), pick]


STANDARD = Dialect()
MYSQL = Dialect("mysql", ("`", "`"), hashed="MOD(CRC32({c}), {n})", upsert_by="duplicate", options=(("useCursorFetch", "true"), ("rewriteBatchedStatements", "true")))
POSTGRES = Dialect("postgres", mod="({c} % {n})", hashed="MOD(ABS(hashtext(CAST({c} AS text))::bigint), {n})", upsert_by="conflict", options=(("defaultRowFetchSize", "5000"),))
ORACLE = Dialect("oracle", limit_at="fetch", hashed="MOD(ORA_HASH({c}), {n})", upsert_by="merge_dual", add_column="ALTER TABLE {table} ADD ({column} {kind})", stamp="TIMESTAMP '{0}'", options=(("defaultRowPrefetch", "5000"),))
SQLSERVER = Dialect("sqlserver", ("[", "]"), limit_at="top", mod="({c} % {n})", hashed="(ABS(CAST(CHECKSUM({c}) AS bigint)) % {n})", upsert_by="merge", add_column="ALTER TABLE {table} ADD {column} {kind}")
H2 = Dialect("h2", ("", ""), upsert_by="merge_key")
DERBY = Dialect("derby", limit_at="fetch", upsert_by="merge_derby", stamp="TIMESTAMP('{0}')")

_BY_NAME = {"mysql": MYSQL, "mariadb": MYSQL, "postgres": POSTGRES, "postgresql": POSTGRES, "oracle": ORACLE, "sqlserver": SQLSERVER, "h2": H2, "derby": DERBY}


def register(name: str, dialect: Dialect) -> None:
    _BY_NAME[name.lower()] = dialect


def by_name(name: str) -> Dialect:
    """The dialect of a source type, or of "module:NAME"."""
    return named(name) if ":" in (name or "") else _BY_NAME.get((name or "").lower(), STANDARD)


def by_url(url: str) -> Dialect:
    return by_name(url.removeprefix("jdbc:").split(":")[0]) if url.startswith("jdbc:") else STANDARD
