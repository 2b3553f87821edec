"""Incremental passes as a stream: a polling source with offsets, and merges by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from keelson.config import JobConfig
from keelson.sources.sinks import open_sink


class RowGroup(InputPartition):
    """The rows of a row group whose ids are in (lo, hi]."""

    def __init__(self, lo: int, hi: int, path: str, group: int) -> None:
        super().__init__(None)
        self.lo, self.hi, self.path, self.group = lo, hi, path, group


class PollingSource(DataSource):
    """format("keelson_poll"): new ids of a Parquet table whose id only grows, as ranges (from, to].

    Offsets have an upper end, so a replayed micro-batch reads the same range. A partition is a row group that may have
    ids of the range, however sparse they are; it is read by ``batch`` rows. Ids may be negative; rows without one are
    never read. Options: path, id, batch, from, schema.
    """

    @classmethod
    def name(cls) -> str:
        return "keelson_poll"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return PollingReader(dict(self.options), schema)


class PollingReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: object) -> None:
        self.path, self.id = options["path"], options.get("id", "id")
        self.batch, self.names, self.first = int(options.get("batch", 100_000)), schema.fieldNames(), int(options.get("from", -(1 << 63)))

    def _dataset(self, path: str | None = None) -> object:
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, at = (None, self.path) if "://" not in self.path else pafs.FileSystem.from_uri(self.path)
        return ds.dataset(path or at, filesystem=fs, format="parquet")

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, row group, least id, largest id) of groups with ids: from statistics, or the column itself where a group has none."""
        import pyarrow.compute as pc

        for fragment in self._dataset().get_fragments():
            for group in fragment.row_groups:
                said = (group.statistics or {}).get(self.id)
                if said is None:
                    said = pc.min_max(fragment.subset(row_group_ids=[group.id]).to_table(columns=[self.id])[self.id]).as_py()
                if said["max"] is not None:
                    yield fragment.path, group.id, said["min"], said["max"]

    def latestOffset(self) -> dict:
        return {"id": max([self.first, *(top for *_, top in self._groups())])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["id"], end["id"]
        return [RowGroup(lo, hi, path, group) for path, group, least, top in self._groups() if top > lo and least <= hi]

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow.compute as pc

        wanted = (pc.field(self.id) > partition.lo) & (pc.field(self.id) <= partition.hi)
        for fragment in self._dataset(partition.path).get_fragments():
            yield from fragment.subset(row_group_ids=[partition.group]).to_batches(columns=self.names, filter=wanted, batch_size=self.batch)


def poll(spark: SparkSession, path: str, id_column: str = "id", batch: int = 100_000) -> DataFrame:
    spark.dataSource.register(PollingSource)
    schema = spark.read.parquet(path).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.readStream.format("keelson_poll").options(path=path, id=id_column, batch=str(batch), schema=ddl).load()


def merge_stream(stream: DataFrame, cfg: JobConfig, checkpoint: str) -> object:
    """Start a query that merges every micro-batch into the configured target and ends when the source is drained.

    A micro-batch that comes again after a crash merges to the same target.
    """

    def each(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            open_sink(rows.sparkSession, cfg).write(rows)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
