"""Targets. Each takes a DataFrame of rows or changes (``_op``), says whether it can be read back, and may be replayed.

``register`` adds a target type: a class with the same methods.
"""

from __future__ import annotations

import base64
import contextlib
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.config import SINKS, JobConfig, named
from keelson.functions.values import OP, row_hash
from keelson.operators import merge
from keelson.sources import embedded, stage
from keelson.sources.dialects import by_url
from keelson.state import FileState


class Sink:
    #: Whether ``read`` gives what is there; whether ``write`` goes over the rows once, in one job.
    readable = one_pass = False

    def __init__(self, spark: SparkSession, cfg: JobConfig) -> None:
        self.spark, self.cfg, self.target, self.keys = spark, cfg, cfg.target, cfg.key

    def write(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def read(self) -> DataFrame | None:
        """What the target holds; None if it does not exist yet."""
        raise ValueError(f"a {self.target.type} target cannot be read back")

    def reachable(self) -> bool:
        return True


class FileSink(Sink):
    """Appends JSON lines, CSV, TSV, Parquet or ORC files."""

    one_pass = True

    def write(self, rows: DataFrame) -> None:
        kind = self.target.format.lower()
        writer = rows.write.mode("append")
        if kind in ("csv", "tsv"):
            writer.option("header", True).option("emptyValue", '""').option("nullValue", "").option("sep", "\t" if kind == "tsv" else ",").csv(self.target.path)
        elif kind in ("parquet", "orc"):
            writer.format(kind).save(self.target.path)
        else:
            writer.option("ignoreNullFields", False).json(self.target.path)


class SnapshotSink(Sink):
    """A Parquet table by snapshots and changes on top of them. A write adds a folder of changes and then a pointer that
    names all folders, so readers and failed runs see whole tables only; when the changes are as large as the snapshot,
    both are written as a new one. So n writes cost a few times the data, not n times the table.

    Pointers are numbered and never replaced: the highest one counts. Folders that neither of the last two names are removed.
    """

    readable = True
    #: Folders of changes at most.
    MOST = 50

    def _state(self) -> FileState:
        return FileState(self.spark, self.target.path.rstrip("/") + "/_pointer")

    def _folder(self, name: str) -> str:
        return f"{self.target.path.rstrip('/')}/{name}"

    def folders(self) -> list[str]:
        """The snapshot's folder and those of changes, in order; none if there is no table yet."""
        state = self._state()
        numbers = state.keys("snapshot")
        return json.loads(state.get("snapshot", numbers[-1])) if numbers else []

    def _point(self, names: list[str]) -> None:
        state = self._state()
        numbers = state.keys("snapshot")
        state.put("snapshot", f"{int(numbers[-1]) + 1 if numbers else 0:012d}", json.dumps(names))
        if len(numbers) > 1:
            kept = {*names, *json.loads(state.get("snapshot", numbers[-1]))}
            for number in numbers[:-1]:
                for name in {*json.loads(state.get("snapshot", number))} - kept:
                    stage.remove(self.spark, self._folder(name))
                state.put("snapshot", number, None)

    def _bytes(self, name: str) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def read(self) -> DataFrame | None:
        names = self.folders()
        if not names:
            return None
        base, *changes = (self.spark.read.parquet(self._folder(n)) for n in names)
        if not changes:
            return base
        if self.target.write_mode != "merge":
            return reduce(merge.append, changes, base)
        numbered = [c.withColumn("_turn", F.lit(i)) for i, c in enumerate(changes)]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
        order = [F.col("_turn"), merge.is_delete(both).cast("int"), F.to_json(F.struct(*(F.col(c) for c in both.columns if c != "_turn")))]
        return merge.apply_changes(base, both, self.keys, order).drop("_turn")

    def _save(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(self._folder(name))
        return name

    def write(self, rows: DataFrame) -> None:
        names = self.folders()
        if not names:
            empty = self.spark.createDataFrame([], rows.drop(OP).schema)
            self._point([self._save(merge.apply_changes(empty, rows, self.keys) if self.target.write_mode == "merge" else merge.append(empty, rows), "snapshot")])
            return
        if not self.cfg.quality.auto_add_columns:
            have = self.spark.read.parquet(self._folder(names[0])).columns
            rows = rows.select(*(c for c in rows.columns if c in have or c == OP))
        names = [*names, self._save(rows, "changes")]
        self._point(names)
        if len(names) > self.MOST or sum(map(self._bytes, names[1:])) >= self._bytes(names[0]):
            self._point([self._save(self.read(), "snapshot")])


class TableSink(Sink):
    """A catalog table: MERGE INTO where the table's format has it, else append."""

    readable = True

    @property
    def name(self) -> str:
        return self.target.table

    def read(self) -> DataFrame | None:
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def write(self, rows: DataFrame) -> None:
        if self.target.write_mode == "append" or not self.keys or self.read() is None:
            rows.drop(OP).write.mode("append").saveAsTable(self.name)
            return
        last = merge.keep_latest(rows, self.keys, [merge.is_delete(rows).cast("int")])
        view = f"keelson_changes_{uuid.uuid4().hex}"
        last.withColumn(OP, F.when(merge.is_delete(last), "d").otherwise("u")).createOrReplaceTempView(view)
        names = [c for c in last.columns if c != OP]
        on = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in self.keys)
        sets = ", ".join(f"t.`{c}` = s.`{c}`" for c in names if c not in self.keys)
        update = f"WHEN MATCHED AND s.{OP} = 'u' THEN UPDATE SET {sets} " if sets else ""
        self.spark.sql(f"MERGE INTO {self.name} t USING {view} s ON {on} WHEN MATCHED AND s.{OP} = 'd' THEN DELETE {update}WHEN NOT MATCHED AND s.{OP} = 'u' THEN INSERT ({', '.join(f'`{c}`' for c in names)}) VALUES ({', '.join(f's.`{c}`' for c in names)})")


class PaimonSink(TableSink):
    """A table of a Paimon catalog in ``warehouse``; its connector has to be there. Options are those of the table."""

    CATALOG = "keelson_paimon"

    @property
    def name(self) -> str:
        return f"{self.CATALOG}.{self.target.catalog_db}.{self.target.table}"

    def __init__(self, spark: SparkSession, cfg: JobConfig) -> None:
        super().__init__(spark, cfg)
        spark.conf.set(f"spark.sql.catalog.{self.CATALOG}", "org.apache.paimon.spark.SparkCatalog")
        spark.conf.set(f"spark.sql.catalog.{self.CATALOG}.warehouse", cfg.target.warehouse)

    def create(self, rows: DataFrame) -> str:
        """The statement that makes the table, with its primary key."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(OP).schema.fields)
        options = ({"primary-key": ",".join(self.keys)} if self.keys else {}) | self.target.options
        said = ", ".join(f"'{k}' = '{v}'" for k, v in options.items())
        return f"CREATE TABLE IF NOT EXISTS {self.name} ({columns})" + (f" TBLPROPERTIES ({said})" if said else "")

    def write(self, rows: DataFrame) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.CATALOG}.{self.target.catalog_db}")
        self.spark.sql(self.create(rows))
        super().write(rows)


class JdbcSink(Sink):
    """A database table. Executors write changes to a staging table; one set of statements then merges it in a transaction.

    Rows of a database that executors cannot see, one inside the driver's process, pass through the driver.
    """

    readable = True

    def _properties(self) -> dict[str, str]:
        own = {"user": self.target.user, "password": self.target.password, "batchsize": str(self.cfg.runtime.write_batch_size)}
        return {k: v for k, v in (own | self.target.options).items() if v != ""}

    def _execute(self, statements: list[str]) -> None:
        c = self.spark._jvm.java.sql.DriverManager.getConnection(self.target.url, self.target.user, self.target.password)
        try:
            c.setAutoCommit(False)
            for sql in statements:
                s = c.createStatement()
                s.executeUpdate(sql)
                s.close()
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def reachable(self) -> bool:
        try:
            self.spark._jvm.java.sql.DriverManager.getConnection(self.target.url, self.target.user, self.target.password).close()
        except Exception:
            return False
        return True

    def _there(self) -> DataFrame:
        return self.spark.read.jdbc(self.target.url, self.target.table, properties=self._properties())

    def read(self) -> DataFrame | None:
        if embedded.away(self.spark, self.target.url):
            return embedded.read(self.spark, self.target.url, self.target.table, self._properties(), self.cfg.runtime.stage_path)
        return self._there()

    def _append(self, rows: DataFrame, table: str) -> None:
        if embedded.away(self.spark, self.target.url):
            embedded.append(rows, self.target.url, table, self._properties())
        else:
            rows.write.jdbc(self.target.url, table, mode="append", properties=self._properties())

    def _named(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        """Column names in the target's spelling."""
        names = {c.lower(): c for c in there.columns}
        return rows.select(*(F.col(c).alias(names.get(c.lower(), c)) for c in rows.columns))

    def write(self, rows: DataFrame) -> None:
        dialect, t = by_url(self.target.url), self.target
        there = self._there()
        if self.cfg.quality.auto_add_columns:
            added = merge.missing_columns(rows.schema, there.schema)
            if added:
                self._execute([dialect.add(t.table, f.name, merge.column_type(f.dataType)) for f in added])
                there = self._there()
        rows = self._named(rows, there)
        rows = rows.select(*(c for c in rows.columns if c in there.columns or c == OP))
        if t.write_mode == "append" or not self.keys:
            if OP in rows.columns and rows.where(merge.is_delete(rows)).limit(1).count():
                raise ValueError("deletes need a primary key")
            self._append(rows.drop(OP), t.table)
            return
        names = {c.lower(): c for c in there.columns}
        keys = [names[k.lower()] for k in self.keys]
        last = merge.keep_latest(rows, keys, [merge.is_delete(rows).cast("int")])
        gone = merge.is_delete(last)
        names = [c for c in last.columns if c != OP]
        kinds = rows.agg(F.max(merge.is_delete(rows)), F.max(~merge.is_delete(rows))).first()
        parts = [last.where(gone).select(*keys) if kinds[0] else None, last.where(~gone).select(*names) if kinds[1] else None]
        staged = {f"KEELSON_{uuid.uuid4().hex[:20].upper()}": (part, i == 0) for i, part in enumerate(parts) if part is not None}
        try:
            todo = []
            for name, (part, deletes) in staged.items():
                texts = ", ".join(f"`{c}` {kind}" for c, kind in self._text_types().items() if c in part.columns)
                away = embedded.away(self.spark, t.url)
                first = self.spark.createDataFrame([], part.schema) if away else part
                writer = first.write.option("createTableColumnTypes", texts) if texts else first.write
                writer.jdbc(t.url, name, mode="overwrite", properties=self._properties())
                if away:
                    embedded.append(part, t.url, name, self._properties())
                todo += [dialect.delete_staged(t.table, name, keys)] if deletes else dialect.upsert_staged(t.table, name, names, keys)
            if todo:
                self._execute(todo)
        finally:
            for name in staged:
                with contextlib.suppress(Exception):  # one that was not made
                    self._execute([f"DROP TABLE {name}"])

    def _text_types(self) -> dict[str, str]:
        """The target's VARCHAR columns with their sizes; longer texts have the connector's type for them."""
        c = self.spark._jvm.java.sql.DriverManager.getConnection(self.target.url, self.target.user, self.target.password)
        try:
            meta = c.createStatement().executeQuery(f"SELECT * FROM {self.target.table} WHERE 1 = 0").getMetaData()
            found = [(meta.getColumnName(i), meta.getColumnTypeName(i).upper(), meta.getPrecision(i)) for i in range(1, meta.getColumnCount() + 1)]
        finally:
            c.close()
        return {name: f"VARCHAR({size})" for name, kind, size in found if "CHAR" in kind and 0 < size <= 32_672}


class ConsoleSink(Sink):
    def write(self, rows: DataFrame) -> None:
        rows.show(20, truncate=False)
        print(f"{rows.count()} rows")


def kafka_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key and value: the key's texts joined by ``|`` (without a key, the row's hash), the row with ``_op`` as JSON."""
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)) if keys else row_hash(rows).cast("string")
    return rows.select(key.alias("key"), F.to_json(F.struct(*map(F.col, rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


class KafkaSink(Sink):
    one_pass = True

    def write(self, rows: DataFrame) -> None:
        writer = kafka_rows(rows, self.keys).write.format("kafka").option("kafka.bootstrap.servers", self.target.brokers).option("topic", self.target.topic)
        writer.options(**{"kafka.acks": self.target.acks, "kafka.enable.idempotence": "true", "kafka.linger.ms": "5"} | self.target.options).save()


DELETE_SIGN = "__DORIS_DELETE_SIGN__"


def doris_rows(rows: DataFrame) -> DataFrame:
    """value: a row as JSON with the delete sign, "1" for deletes."""
    names = [c for c in rows.columns if c != OP]
    sign = F.when(merge.is_delete(rows), "1").otherwise("0").alias(DELETE_SIGN)
    return rows.select(F.to_json(F.struct(*map(F.col, names), sign), {"ignoreNullFields": "false"}).alias("value"))


class _Follow(urllib.request.HTTPRedirectHandler):
    """Sends a request again, body, method and login included, to the backend that a frontend names."""

    def redirect_request(self, req: urllib.request.Request, fp: object, code: int, msg: str, headers: object, newurl: str) -> urllib.request.Request:
        return urllib.request.Request(newurl, req.data, dict(req.header_items()), method=req.get_method())


class DorisSink(Sink):
    """Stream load over HTTP, a batch of rows in one JSON array; a label names the batch, so a retried task does not load twice."""

    one_pass = True

    def write(self, rows: DataFrame) -> None:
        t, size, run = self.target, self.cfg.runtime.write_batch_size, uuid.uuid4().hex
        url = f"{t.http_url.rstrip('/')}/api/{t.database or 'default_cluster'}/{t.table}/_stream_load"
        login = base64.b64encode(f"{t.user or 'root'}:{t.password}".encode()).decode()

        def send(values: list[str], part: int, batch: int) -> None:
            head = {"Authorization": f"Basic {login}", "Expect": "100-continue", "format": "json", "strip_outer_array": "true", "merge_type": "MERGE", "delete": f'{DELETE_SIGN}="1"', "label": f"keelson-{run}-{part}-{batch}"}
            request = urllib.request.Request(url, ("[" + ",".join(values) + "]").encode(), head, method="PUT")
            with urllib.request.build_opener(_Follow).open(request, timeout=600) as answer:
                said = json.loads(answer.read() or b"{}")
            if said.get("Status", "Success") not in ("Success", "Publish Timeout", "Label Already Exists"):
                raise OSError(f"stream load failed: {said}")

        def run_part(frames: object) -> object:
            import pandas as pd
            from pyspark import TaskContext

            part, batch, held = TaskContext.get().partitionId(), 0, []
            for frame in frames:
                for value in frame["value"]:
                    held.append(value)
                    if len(held) >= size:
                        send(held, part, batch)
                        batch, held = batch + 1, []
            if held:
                send(held, part, batch)
            yield pd.DataFrame({"n": []}, dtype="int64")

        doris_rows(rows).mapInPandas(run_part, "n long").write.format("noop").mode("overwrite").save()


_TYPES: dict[str, Callable[[SparkSession, JobConfig], Sink]] = {"file": FileSink, "parquet": SnapshotSink, "table": TableSink, "jdbc": JdbcSink, "console": ConsoleSink, "kafka": KafkaSink, "doris": DorisSink, "starrocks": DorisSink, "paimon": PaimonSink}


def register(name: str, make: Callable[[SparkSession, JobConfig], Sink], required: tuple[str, ...] = ()) -> None:
    """Adds a type of target, and the keys of its configuration that it needs."""
    _TYPES[name] = make
    SINKS.setdefault(name, required)


def open_sink(spark: SparkSession, cfg: JobConfig) -> Sink:
    make = named(cfg.target.type) if ":" in cfg.target.type else _TYPES[cfg.target.type]
    return make(spark, cfg)
