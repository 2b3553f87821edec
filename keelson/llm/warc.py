"""WARC archives of pages: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. Of the pages with equal payloads (of at least
``revisit_from`` bytes) the one with the largest page_id is written as a response; the others
are revisits: they name it, and carry the payload's digest and length but not the payload.

The reader cuts archives into byte ranges. A task looks for gzip's magic in its range, takes
a place for a member only if its header decodes and it inflates to the first line of a WARC
record, and owns the records that start in its range; from one record it goes on to where
that member ends, also past the end of the range. So every record is read once, whatever the
ranges are.

Writers put each record into a file of the shared folder as it comes, under a name of their
attempt, and go on in another one at FILE_BYTES; only files named in the table they return
belong to the archive, so lost and doubled tasks leave it whole.

Defined results: a null html is an empty payload; a null url is left out. Rows with one page_id
and payload are all responses if that id is the largest, each with a record. Of equal
payloads without any page_id all are responses. An empty table gives no files and no rows.
Extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import fresh_dir, materialize, store

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
URN = "urn:keelson:page:"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a range of the reader, and of one read.
SPLIT, CHUNK = 8 << 20, 1 << 20
#: Bytes from which on a writer goes on in another file.
FILE_BYTES = 1 << 30
#: Payloads of more than one page whose owners are broadcast at most (some 100 bytes each).
BROADCAST_OWNERS = 500_000
#: Bytes that a candidate is inflated to before it counts as a record.
PROBE = 64
LEVEL = 5


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n\t " else c for c in value)


def record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_classes(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, digest (sha1, hex) and refers_to: null for responses.

    Owners of payloads are found from ids and digests alone, combined before the shuffle. Of payloads that more pages
    share, up to BROADCAST_OWNERS owners are sent to all tasks, and payloads stay where they are; beyond, pages join them
    in a shuffle, where a payload that many pages share is one key, whose partitions AQE splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    owners = t.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 AND owner IS NOT NULL").select("digest", "owner")
    owners = materialize(owners, "owners")
    if owners.count() <= BROADCAST_OWNERS:
        owners = F.broadcast(owners)
    other = (F.octet_length("payload") >= revisit_from) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return t.join(owners, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("owner")).alias("refers_to"))


class _Archive:
    """An archive that is written record by record, to a name of its own; nothing is held but the file's buffer."""

    def __init__(self, path: str) -> None:
        fs, at = store(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.size, self.out = path, 0, fs.open_output_stream(at, compression=None)  # members are packed one by one
        info = b"software: keelson\r\nformat: WARC File Format 1.1\r\n"
        head = VERSION + f"\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:keelson:info>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
        self.add(head + info + b"\r\n\r\n")

    def add(self, raw: bytes) -> None:
        packed = member(raw)
        self.out.write(packed)
        self.size += len(packed)

    def done(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "size": [self.size]})


def write(classed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of about ``file_bytes``, each from one task; path and size of each, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, number, archive = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            for k in range(len(batch)):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in batch.columns)
                if archive is None:
                    archive = _Archive(f"{path}-{number:04d}.warc.gz")
                kind = "response" if refers_to is None else "revisit"
                archive.add(record(page_id, url, kind, base64.b32encode(bytes.fromhex(digest)).decode(), len(payload), payload, refers_to))
                if archive.size >= file_bytes:
                    yield archive.done()
                    archive, number = None, number + 1
        if archive is not None:
            yield archive.done()

    return materialize(classed.mapInArrow(run, "path string, size long"), "archives")


# ---------------------------------------------------------------- reading


class _Source:
    """Bytes of a file from a place on, read in chunks; what lies before the place asked for last is let go."""

    def __init__(self, path: str) -> None:
        fs, at = store(path)
        self.file, self.at, self.have = fs.open_input_file(at), 0, b""
        self.size = self.file.size()

    def get(self, start: int, n: int) -> bytes:
        """Up to n bytes from start on."""
        if not self.at <= start <= self.at + len(self.have):
            self.at, self.have = start, b""
        if start > self.at:
            self.have, self.at = self.have[start - self.at :], start
        while len(self.have) < n and self.at + len(self.have) < self.size:
            self.have += self.file.read_at(min(CHUNK, self.size - self.at - len(self.have)), self.at + len(self.have))
        return self.have[:n]

    def rest(self, start: int) -> Iterator[bytes]:
        """Chunks from start on."""
        while start < self.size:
            chunk = self.get(start, min(CHUNK, self.size - start))
            yield chunk
            start += len(chunk)


def is_record(source: _Source, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts there: its header decodes and it inflates to the version line."""
    head = source.get(at, 4096)
    if not head.startswith(MAGIC) or len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, PROBE).startswith(b"WARC/1.")
    except zlib.error:
        return False


def next_record(source: _Source, at: int, end: int) -> int | None:
    """The first record that starts in [at, end)."""
    while at < end:
        chunk = source.get(at, min(CHUNK, end - at + len(MAGIC) - 1))
        found = chunk.find(MAGIC)
        if found < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        if at + found >= end:
            return None
        if is_record(source, at + found):
            return at + found
        at += found + 1
    return None


def inflate(source: _Source, at: int) -> tuple[bytes, int]:
    """The member that starts there, and where it ends."""
    unpacker, out, end = zlib.decompressobj(31), [], at
    for chunk in source.rest(at):
        out.append(unpacker.decompress(chunk))
        end += len(chunk)
        if unpacker.eof:
            return b"".join(out), end - len(unpacker.unused_data)
    raise ValueError(f"a record at byte {at} is cut off")


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of a response or revisit; {} for others."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return {}
    number = lambda name: int(v) if (v := fields.get(name, "").removeprefix(f"<{URN}").removesuffix(">")) else None
    http, _, payload = body[: int(fields["content-length"])].partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))[15:])
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (said, size):
            raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


_COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}


def read(files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row per response or revisit of the archives (path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    names = [c for c in _COLUMNS if payloads or c not in ("payload", "url")]
    spans = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("lo"))
    count = files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    ranges = spans.select("path", "lo", F.least(F.col("lo") + split, F.col("size")).alias("hi")).repartition(max(1, min(int(count), 100_000)), "path", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, rows, held = _Source(path), [], 0
                at = next_record(source, lo, hi)
                while at is not None and at < hi:
                    raw, end = inflate(source, at)
                    if row := parse(raw):
                        rows.append(row)
                        held += len(raw)
                    at = end if end >= hi or is_record(source, end) else next_record(source, end, hi)
                    if held > 1 << 22:
                        yield _batch(rows, names)
                        rows, held = [], 0
                yield _batch(rows, names)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ranges.mapInArrow(run, ", ".join(f"{c} {kinds[_COLUMNS[c]]}" for c in names))


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _COLUMNS[c]) for c in names], names)


def query(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """One row per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(with_classes(pages, revisit_from), fresh_dir(pages.sparkSession, "warc")), payloads=False)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
o AS (SELECT hex, max(page_id) AS owner FROM d GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((('0x' || substr(hex, CAST(i * 5 // 4 + 1 AS INT), 2))::INT) // CAST(pow(2, 3 - (i * 5) % 4) AS INT)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d JOIN o USING (hex)
"""
