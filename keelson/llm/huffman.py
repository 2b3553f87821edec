"""Token-id files: canonical length-limited Huffman codes with independent blocks.

Documents are encoded by a public tokenizer, an end id is appended, and ids are counted over
all documents. From the counts come code lengths of at most LIMIT bits (package-merge) and
canonical codes. Files hold documents in ascending doc_id order, in blocks that are decoded
on their own:

file    MAGIC, header size (u32), header (zlib-packed JSON and code lengths), blocks
block   u32 documents, u32 checkpoints; for each document its id (i64), a null flag (u8),
        tokens (u32), bytes (u32); for each checkpoint a bit offset (u32) in its document;
        then the documents' bits, each document from a whole byte on, highest bit first.

A checkpoint stands before every STEP-th token of a document, so decoding runs over many
places at once: each lane peeks LIMIT bits, looks up symbol and length in one table, and
goes on (numpy). The index (file, offset, size, first token) comes from the writers.

Texts are cut at ASCII white space, which the tokenizer drops and no token crosses, and between
ASCII letters and signs where its file tells that it always cuts there; each distinct part is
encoded once for many texts by the tokenizers library.

Defined results: a null or empty text has the end id only. Null ids come first; rows of one
id are ordered by their tokens (where they are very many, by a hash of these first, so that
several tasks share them). An empty table gives no files and no rows. Extra columns do
not matter.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import kernel
from keelson.llm.common import fresh_dir, materialize, put, store
from keelson.llm.kernel import ranges

MAGIC = b"KSHF1\n"
#: Bits of a code at most, unless there are more ids than that allows.
LIMIT = 16
STEP = 256
#: Lowest bits of a decoding table's entry, which hold a code's length.
_SIZE_BITS, _SIZE = 5, 31
BLOCK_TOKENS = 1 << 19
FILE_TOKENS = 1 << 23
#: Parts that documents are dealt out to at most, in order; a part beyond FILE_BYTES has several files.
PARTS, FILE_BYTES = 1 << 14, 1 << 26
#: Parts in one text for the tokenizer; its time a part grows again with longer texts.
JOINED = 50
_NO_ID = -(1 << 63)
END_ID = 2
_TOKENIZERS: dict[str, tuple] = {}
#: The decoding table of the last header that a worker met: its tasks need it again and again.
_TABLES: dict[bytes, tuple] = {}
#: Blocks that a task reads, one after another; a task has a cost of its own.
BLOCKS = 4


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for counts above zero (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        is_leaf = np.concatenate([np.ones(len(leaves), bool), np.zeros(len(packages), bool)])
        by = np.argsort(merged, kind="stable")
        merged, is_leaf = merged[by], is_leaf[by]
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * len(used) - 2
    lengths = np.zeros(len(order), np.int64)
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id: each the next number after the one before, moved to its length."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=0))
    # in units of the longest code, code i starts where the ones before it end
    width = np.int64(1) << (top - lengths[order].astype(np.int64))
    codes[order] = (np.cumsum(width) - width) >> (top - lengths[order].astype(np.int64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """An entry for the next ``top`` bits, symbol << _SIZE_BITS | length; and top."""
    top = int(lengths.max(initial=0))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = np.int64(1) << (top - lengths[order].astype(np.int64))
    entries = np.repeat((order << _SIZE_BITS | lengths[order]).astype(np.uint32), width)
    return np.concatenate([entries, np.ones((1 << top) - len(entries), np.uint32)]), top


def pack(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bits, bytes of each document, checkpoints of all documents): rows ids[offsets[i]:offsets[i+1]]."""
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    doc_bits = np.diff(ends[offsets])
    doc_bytes = (doc_bits + 7) // 8
    byte_at = np.cumsum(doc_bytes) - doc_bytes
    n = np.diff(offsets)
    within = ends[:-1] - np.repeat(ends[offsets[:-1]], n)
    marks = (np.arange(len(ids)) - np.repeat(offsets[:-1], n)) % STEP == 0
    checkpoints = within[marks].astype(np.uint32)
    pos = within + np.repeat(byte_at * 8, n)
    total = int(doc_bytes.sum())
    words = np.zeros(total // 4 + 3, np.uint64)
    if len(ids):
        value = codes[ids].astype(np.uint64) << (64 - size - (pos & 31)).astype(np.uint64)
        at = pos >> 5
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        both = np.bitwise_or.reduceat(value, cut)
        words[at[cut]] |= both >> np.uint64(32)
        words[at[cut] + 1] |= both & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[:total], doc_bytes, checkpoints


def unpack(bits: bytes | memoryview, doc_bytes: np.ndarray, n_tokens: np.ndarray, checkpoints: np.ndarray, entries: np.ndarray, top: int) -> np.ndarray:
    """The ids of all documents, one after another."""
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    lanes_of = (n_tokens + STEP - 1) // STEP
    doc = np.repeat(np.arange(len(n_tokens)), lanes_of)
    lane = np.arange(len(doc)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    size = np.minimum(STEP, n_tokens[doc] - lane * STEP)
    order = np.argsort(-size, kind="stable")
    pos = ((np.cumsum(doc_bytes) - doc_bytes)[doc] * 8 + checkpoints.astype(np.int64))[order]
    active = np.searchsorted(-size[order], -np.arange(1, STEP + 1), "right")  # lanes with more than k tokens
    begin = np.cumsum(active) - active
    found = np.empty(int(active.sum()), entries.dtype)  # step by step
    at, peek, mask = np.empty(len(pos), np.int64), np.empty(len(pos), np.uint32), (1 << top) - 1
    for n, first in zip(active[active > 0].tolist(), begin.tolist(), strict=False):
        p, a, w, e = pos[:n], at[:n], peek[:n], found[first : first + n]
        np.right_shift(p, 3, out=a)
        window.take(a, out=w, mode="clip")  # all are inside; other modes copy
        np.bitwise_and(p, 7, out=a)
        np.subtract(32 - top, a, out=a)
        np.right_shift(w, a, out=a)
        np.bitwise_and(a, mask, out=a)
        entries.take(a, out=e, mode="clip")
        np.bitwise_and(e, _SIZE, out=a, casting="unsafe")
        p += a
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return (found.take(_by_lane(begin, place, size)) >> _SIZE_BITS).astype(np.uint32)


def _by_lane(begin: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the tokens of each lane are, lane by lane: begin[k] + its place for its k-th."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return begin[step] + np.repeat(place, size)


# ---------------------------------------------------------------- tokens


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(key: str, content: str) -> tuple:
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[key] = (Tokenizer.from_str(content), kernel.Pool(), joints(content))
    return _TOKENIZERS[key]


#: A pre-tokenizer that keeps letters and signs apart, whatever stands beside them; apostrophes begin contractions.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def joints(content: str) -> np.ndarray:
    """1 for ASCII letters and 2 for ASCII signs between which the tokenizer (its file's text) always cuts, by byte; 0 for all others, or if it is of an unknown kind."""
    out, own = np.zeros(256, np.uint8), json.loads(content)
    pre, normal = own.get("pre_tokenizer") or {}, own.get("normalizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
    kinds = {x["type"] if x["type"] != "Replace" else json.dumps(x["pattern"]) + x["content"] for x in normal.get("normalizers", [normal] if normal else [])}
    if steps == [("Split", {"Regex": _WORDS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)] and kinds <= {"NFC", "Lowercase", json.dumps({"Regex": r"\s+"}) + " "}:
        added = set("".join(t["content"] for t in own.get("added_tokens") or []))
        for i in range(33, 127):
            out[i] = 1 if chr(i).isalpha() else 2 if not chr(i).isdigit() and chr(i) != "'" and chr(i) not in added else 0
    return out


def encode(data: np.ndarray, offsets: np.ndarray, tokenizer: object, pool: kernel.Pool, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by row). ``kinds``: what ``joints`` says of the tokenizer."""
    cuts = None
    if kinds is not None and kinds.any():
        kind = kinds[data]
        cuts = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1
    h, start, end, first = kernel.words(data, offsets, lower=np.arange(256, dtype=np.uint8), cuts=cuts)
    if not len(h):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)

    def fresh(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # all in one text, a line each
        size = end[new] - start[new]
        lines = np.full(int(size.sum()) + len(new), 10, np.uint8)
        lines[ranges(np.cumsum(size + 1) - size - 1, size)] = data[ranges(start[new], size)]
        return encode_parts(lines.tobytes().decode("utf-8", "replace").split("\n")[:-1], tokenizer)

    place, counts = pool.find(kernel.Units(data, start, end, h), fresh)
    return pool.ids[ranges(place, counts)], np.concatenate([[0], np.cumsum(counts)])[first]


def encode_parts(parts: list[str], tokenizer: object) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of parts without white space. Many are put in one text with a special token between them, which costs less than a call for each."""
    run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    # the sign is the only token that can be found across a joint if no token's first character is in a part or further on in the sign
    first = {t[0] for t in special.values()}
    mark, sign = next(((i, t) for i, t in special.items() if not first & set(t[1:])), (None, None))
    joins = [mark is not None] * len(parts)
    for c in first:
        joins = [j and c not in p for j, p in zip(joins, parts, strict=True)]
    alone, together = [k for k, j in enumerate(joins) if not j], [k for k, j in enumerate(joins) if j]
    size, flat = np.zeros(len(parts), np.int64), [np.zeros(0, np.int32)]
    texts = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
    if texts:
        end = np.array([mark], np.int32)  # of each text, as between its parts
        ids = np.concatenate([y for x in run([sign.join([parts[k] for k in t]) for t in texts], add_special_tokens=False) for y in (np.array(x.ids, np.int32), end)])
        joint = ids == mark
        size[together] = np.diff(np.flatnonzero(joint), prepend=-1) - 1
        flat.append(ids[~joint])
    for k, x in zip(alone, run([parts[k] for k in alone], add_special_tokens=False) if alone else [], strict=True):
        flat.append(np.array(x.ids, np.int32))
        size[k] = len(x.ids)
    ids = np.concatenate(flat)
    if alone:
        order = np.array(together + alone, np.int64)
        begin = np.zeros(len(parts), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        ids = ids[ranges(begin, size)]
    return ids, np.concatenate([[0], np.cumsum(size)])


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, width: int = 4) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned integers of ``width`` bytes, the end id last."""
    path = tokenizer_path or default_tokenizer()
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pool, kinds = _tokenizer(path, content.value)
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            for a, b in kernel.row_slices(offsets, kernel.PIECE):
                ids, at = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tokenizer, pool, kinds)
                n = np.diff(at)
                full = np.full(len(ids) + b - a, end_id, f"<u{width}")
                full[np.arange(len(ids)) + np.repeat(np.arange(b - a), n)] = ids
                ends = np.concatenate([[0], np.cumsum(n + 1)])
                raw = pa.py_buffer(full.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n + 1), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * width).astype(np.int32).tobytes()), raw])], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def narrow_width(tokenizer_path: str | None, end_id: int) -> int:
    """Bytes that hold every id of the tokenizer."""
    from tokenizers import Tokenizer

    return 2 if max(end_id + 1, Tokenizer.from_file(tokenizer_path or default_tokenizer()).get_vocab_size()) <= 1 << 16 else 4


def _id_lists(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ids, offsets) of batches whose column ``ids`` has ids of ``width`` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary())
        _, offs, data = column.buffers()
        at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        yield batch, np.frombuffer(raw.tobytes(), f"<u{width}"), (at - at[0]) // width


def count_ids(tokens: DataFrame, width: int = 4) -> np.ndarray:
    """How often each id occurs: one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for _, ids, _ in _id_lists(batches, width):
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


# ---------------------------------------------------------------- files


@dataclass
class Code:
    lengths: np.ndarray

    def header(self, **more: object) -> bytes:
        body = zlib.compress(json.dumps({"step": STEP, "ids": len(self.lengths)} | more).encode() + b"\n" + self.lengths.tobytes(), 6)
        return MAGIC + struct.pack("<I", len(body)) + body


@dataclass
class Cuts:
    """Where parts begin, ascending: an id, and for ids of very many rows also a byte of a hash of the tokens."""

    ids: np.ndarray
    bytes: np.ndarray

    @staticmethod
    def of(quantiles: list[int]) -> Cuts:
        ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        own = [np.unique(np.arange(t) * 256 // t) for t in times]  # an id that is several quantiles has as many parts, up to 256
        return Cuts(np.repeat(ids, [len(x) for x in own]), np.concatenate([*own, np.zeros(0, np.int64)]))

    def part(self, ids: np.ndarray, byte: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The part of each row; ``byte`` gives the hash's byte of some rows."""
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        out = hi.copy()
        for a, b in {(int(a), int(b)) for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1], strict=True)}:
            here = (lo == a) & (hi == b)
            out[here] = a + np.searchsorted(self.bytes[a:b], byte(np.flatnonzero(here)), "right")
        return out.astype(np.int32)


def write_files(tokens: DataFrame, folder: str, code: Code, file_tokens: int = FILE_TOKENS, width: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id order; the index, as a written table: path, offset, size, first_token by block.

    Parts begin at quantiles of the ids. A part has one task, which holds one block and one file at a time.
    """
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, min(PARTS, -(-int(total) // file_tokens)))
    cuts = Cuts.of([])
    if parts > 1:
        cuts = Cuts.of(tokens.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(_NO_ID)), [i / parts for i in range(1, parts)], 10 * parts + 1000)).first()[0] or [])
    shared = spark.sparkContext.broadcast((cuts, canonical_codes(code.lengths), code.lengths))  # the vocabulary's size, and two numbers for each of at most PARTS parts

    def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cuts, own_codes, own_lengths = shared.value
        for batch, ids, at in _id_lists(batches, width):
            for a, b in kernel.row_slices(at, 1 << 20):
                part = batch.slice(a, b - a)
                bits, doc_bytes, marks = pack(ids[at[a] : at[b]], at[a : b + 1] - at[a], own_codes, own_lengths)
                n = np.diff(at[a : b + 1])
                id_column = part.column(0)
                byte_ends, mark_ends = (np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (doc_bytes, 4 * ((n + STEP - 1) // STEP)))
                byte = lambda which, a=a, at=at, ids=ids: np.array([zlib.crc32(ids[at[a + k] : at[a + k + 1]]) >> 24 for k in which])
                binary = lambda raw, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(own_cuts.part(id_column.fill_null(_NO_ID).to_numpy(), byte)), id_column, pa.array(n), binary(marks.astype("<u4").tobytes(), mark_ends), binary(bits, byte_ends)], ["part", "doc_id", "n_tokens", "marks", "bits"])

    packed = tokens.select("doc_id", "ids").mapInArrow(pack_docs, "part int, doc_id long, n_tokens long, marks binary, bits binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, out, index, first = None, 0, bytearray(), [], 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal rows, first
            if rows:
                body = _block(rows)
                index.append((len(out), len(body), first))
                out.extend(body)
                first += sum(r[1] for r in rows)
                rows = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal index, out, number
            flush()
            if index:
                path = f"{folder}/part-{now:06d}-{number:04d}.ksh"
                put(path, bytes(out))
                offsets, sizes, firsts = zip(*index, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(index), pa.int32()), pa.array([path] * len(index)), pa.array(offsets), pa.array(sizes), pa.array(firsts), pa.array([*firsts[1:], first], pa.int64())], ["part", "path", "offset", "size", "first", "last"])
            index, out, number = [], bytearray(code.header()), number + 1

        for batch in batches:
            for part, doc, n, marks, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield from done()
                    now, number, first, out = part, 0, 0, bytearray(code.header())
                rows.append((doc, n, marks, bits))
                if sum_tokens(rows) >= BLOCK_TOKENS:
                    flush()
                    if len(out) >= file_bytes:
                        yield from done()
        if now is not None:
            yield from done()

    # each part is a partition of its own: hashing would put some together
    ordered = packed.repartitionById(len(cuts.ids) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "bits", "n_tokens")
    index = materialize(ordered.mapInArrow(write, "part int, path string, offset long, size long, first long, last long"), "token-index")
    sums = sorted(tuple(r) for r in index.groupBy("part").agg(F.max("last")).collect())  # one row for each of at most PARTS parts, and 256 for ids of very many rows
    begins, before = [], 0
    for part, n in sums:
        begins.append((part, before))
        before += n
    return index.join(F.broadcast(spark.createDataFrame(begins, "part int, before long")), "part").select("path", "offset", "size", (F.col("first") + F.col("before")).alias("first_token"))


def sum_tokens(rows: list[tuple]) -> int:
    return rows[-1][1] if len(rows) == 1 else BLOCK_TOKENS if len(rows) >= 4096 else sum(r[1] for r in rows)


def _block(rows: list[tuple]) -> bytes:
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    nulls = np.array([r[0] is None for r in rows], np.uint8)
    n = np.array([r[1] for r in rows], "<u4")
    size = np.array([len(r[3]) for r in rows], "<u4")
    marks = b"".join(r[2] for r in rows)
    return b"".join([struct.pack("<II", len(rows), len(marks) // 4), ids.tobytes(), nulls.tobytes(), n.tobytes(), size.tobytes(), marks, *(r[3] for r in rows)])


def read_blocks(index: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the blocks of an index, each block decoded on its own; with ``digest`` ids_crc32 instead of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = store(path)
                with fs.open_input_file(at) as f:
                    head = f.read_at(len(MAGIC) + 4, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{path} is not a token file")
                    packed = f.read_at(struct.unpack("<I", head[len(MAGIC) :])[0], len(MAGIC) + 4)
                    body = f.read_at(size, offset)
                if packed not in _TABLES:
                    _, _, lengths = zlib.decompress(packed).partition(b"\n")
                    _TABLES.clear()  # one at a time
                    _TABLES[packed] = decode_table(np.frombuffer(lengths, np.uint8))
                docs, marks = struct.unpack_from("<II", body)
                spot = 8
                parts = []
                for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", docs), ("<u4", marks)):
                    parts.append(np.frombuffer(body, kind, count, spot))
                    spot += parts[-1].nbytes
                ids, nulls, n, doc_bytes, checkpoints = parts
                n = n.astype(np.int64)
                tokens = unpack(memoryview(body)[spot:], doc_bytes.astype(np.int64), n, checkpoints, *_TABLES[packed])
                ends = np.concatenate([[0], np.cumsum(n)])
                raw = tokens.astype("<u4").tobytes()
                if digest:
                    view = memoryview(raw)
                    last = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), pa.array(first + ends[:-1]), pa.array(n), last], ["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    return index.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'binary'}")


def save(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenize, count, build the code, write the files; the index of blocks."""
    spark: SparkSession = docs.sparkSession
    path = fresh_dir(spark, "tokens")
    width = narrow_width(tokenizer_path, end_id)
    tokenize(docs, tokenizer_path, end_id, width).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    code = Code(code_lengths(count_ids(tokens, width)))
    return write_files(tokens, folder or fresh_dir(spark, "token-files"), code, width=width)


def query(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    index = save(docs, tokenizer_path=tokenizer_path)
    spread = index.repartition(max(1, min(100_000, -(-index.count() // BLOCKS))), "path", "offset")
    return read_blocks(spread, digest=True)
