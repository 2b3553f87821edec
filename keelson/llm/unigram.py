"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece model file. Its log scores are used where the model is
a Unigram one. The public file at hand is a BPE model, whose scores are minus the rank of
the merge; ``log_scores`` then reads the rank r by Zipf's law, log p = -ln(r + 2) - c, with
c so that all p add up to 1.

Encoding follows SentencePiece: a blank is put before the text, blanks become the marker
U+2581 (a marker in the text itself is read as a blank), the segmentation with the highest
sum of scores wins (at a tie the one found first: earlier starts, then shorter pieces), and
a character that no piece covers becomes its UTF-8 bytes' pieces, at the lowest score less
10. Decoding turns pieces to text, markers to blanks, and drops the blank put before.

Pieces do not reach over certain places: before a blank that follows another character, and
around characters that no longer piece holds. Texts are cut there into units; the Viterbi
search runs once for each distinct unit of a batch, for all of them in step (numpy).

Defined results: a null or empty text has no tokens and decodes to the empty text. Null ids,
repeated rows and extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keelson.llm import kernel
from keelson.llm.common import small_batches
from keelson.llm.kernel import ranges

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Bytes of new units that one search goes over, or one longer unit: its working memory is many times that.
SEARCHED = 1 << 17


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + n]
            at += n


def read_model(raw: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) by id, and whether the model is a Unigram one."""
    pieces, unigram = [], True
    for key, value in _fields(raw):
        if key == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif key == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
    return pieces, unigram


def log_scores(pieces: list[tuple[str, float, int]], unigram: bool) -> np.ndarray:
    own = np.array([p[1] for p in pieces], np.float64)
    if unigram:
        return own
    total = math.log(sum(1 / (2 - s) for _, s, kind in pieces if kind == NORMAL))
    return -np.log(2 + np.maximum(0, -own)) - total


@dataclass
class Trie:
    """A double array: from state s, byte b leads to base[s] + b if check there is s; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int


def build_trie(keys: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for key, i in keys.items():
        at = 0
        for b in key:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                ids.append(-1)
            at = children[at][b]
        ids[at] = i
    size = 1 << max(10, (len(children) * 2).bit_length())
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    first_free, queue = 1, [(0, 0)]
    while queue:
        node, state = queue.pop()
        labels = sorted(children[node])
        if not labels:
            continue
        low = labels[0]
        place = max(first_free, low + 1)
        tries = 0
        while True:
            if place + 256 >= len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            if check[place] < 0 and all(check[place - low + b] < 0 for b in labels):
                break
            place += 1
            tries += 1
            if tries == 2000:  # crowded: leave the holes
                first_free = place
        base[state] = place - low
        for b in labels:
            to = place - low + b
            child = children[node][b]
            check[to], value[to] = state, ids[child]
            queue.append((child, to))
        while first_free < len(check) and check[first_free] >= 0:
            first_free += 1
    # room so that base + byte never leaves the arrays
    pad = lambda x, v: np.array([*x, *[v] * 512], np.int32)
    return Trie(pad(base, 0), pad(check, -1), pad(value, -1), max(map(len, keys), default=0))


@dataclass
class Unigram:
    trie: Trie
    scores: np.ndarray  # by piece id
    unknown_score: float
    unknown_id: int
    byte_ids: np.ndarray  # of each byte, or unknown_id
    has_bytes: bool
    text: np.ndarray  # bytes of all pieces, markers as blanks
    text_at: np.ndarray  # offsets by id
    is_byte: np.ndarray
    alone: np.ndarray  # ASCII bytes that no longer piece holds
    whole: bool  # pieces reach over blanks: texts are not cut
    pool: kernel.Pool = field(default_factory=lambda: kernel.Pool(300_000, 1 << 24))


def load(raw: bytes) -> Unigram:
    pieces, unigram = read_model(raw)
    scores = log_scores(pieces, unigram)
    byte_ids, unknown = {}, 0
    keys, texts, is_byte = {}, [], np.zeros(len(pieces), bool)
    for i, (piece, _, kind) in enumerate(pieces):
        shown = b""
        if kind == BYTE:
            byte_ids[int(piece[3:5], 16)] = i
            shown, is_byte[i] = bytes([int(piece[3:5], 16)]), True
        elif kind == UNKNOWN:
            unknown, shown = i, " ⁇ ".encode()
        elif kind in (NORMAL, USER):
            shown = piece.replace(MARKER, " ").encode()
            keys.setdefault(shown, i)
        texts.append(shown)
    longer = [k for k in keys if len(k.decode()) > 1]
    alone = np.ones(256, bool)
    alone[128:] = False
    for k in longer:
        alone[list(k)] = False
    lengths = np.array([len(t) for t in texts])
    return Unigram(
        trie=build_trie(keys),
        scores=scores,
        unknown_score=float(min((scores[i] for i in keys.values()), default=0.0)) - 10,
        unknown_id=unknown,
        byte_ids=np.array([byte_ids.get(b, unknown) for b in range(256)], np.int32),
        has_bytes=len(byte_ids) == 256,
        text=np.frombuffer(b"".join(texts), np.uint8),
        text_at=np.concatenate([[0], np.cumsum(lengths)]),
        is_byte=is_byte,
        alone=alone,
        whole=any(b" " in k.lstrip(b" ") for k in keys),
    )


def viterbi(b: np.ndarray, at: np.ndarray, m: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each unit b[at[i]:at[i+1]]: (ids, offsets of the units in ids)."""
    n, units = len(b), len(at) - 1
    unit_len = np.diff(at)
    unit = np.repeat(np.arange(units), unit_len)
    rel = np.arange(n) - at[unit]
    left = unit_len[unit] - rel
    heads = np.flatnonzero((b & 0xC0) != 0x80)
    char_len = np.diff(np.append(heads, n))
    char_len = np.minimum(char_len, left[heads])
    pos, state = heads, np.zeros(len(heads), np.int64)
    c_start, c_len, c_id = [], [], []
    for depth in range(m.trie.depth):
        keep = left[pos] > depth
        pos, state = pos[keep], state[keep]
        to = m.trie.base[state] + b[pos + depth].astype(np.int64)
        keep = m.trie.check[to] == state
        pos, state = pos[keep], to[keep]
        if not len(pos):
            break
        hit = m.trie.value[state] >= 0
        c_start.append(pos[hit])
        c_len.append(np.full(int(hit.sum()), depth + 1))
        c_id.append(m.trie.value[state[hit]].astype(np.int64))
    starts = np.concatenate([*c_start, np.zeros(0, np.int64)]).astype(np.int64)
    lens = np.concatenate([*c_len, np.zeros(0, np.int64)]).astype(np.int64)
    ids = np.concatenate([*c_id, np.zeros(0, np.int64)]).astype(np.int64)
    own = np.zeros(n + 1, np.int64)
    own[heads] = char_len
    single = np.zeros(n + 1, bool)
    single[starts[lens == own[starts]]] = True
    lost = heads[~single[heads]]
    starts, lens, ids = np.concatenate([starts, lost]), np.concatenate([lens, own[lost]]), np.concatenate([ids, np.full(len(lost), -1)])
    gain = np.where(ids >= 0, m.scores[ids], m.unknown_score)
    order = np.argsort(rel[starts], kind="stable")
    starts, lens, ids, gain = starts[order], lens[order], ids[order], gain[order]
    # one slot more for each unit: slot = position + unit
    best = np.full(n + units, -np.inf)
    best[at[:-1] + np.arange(units)] = 0
    how, span = np.full(n + units, -1, np.int64), np.zeros(n + units, np.int64)
    slot = starts + unit[starts]
    bounds = np.searchsorted(rel[starts], np.arange(int(unit_len.max(initial=0)) + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        s, e = slot[lo:hi], slot[lo:hi] + lens[lo:hi]
        total = best[s] + gain[lo:hi]
        better = total > best[e]
        e = e[better]
        best[e], how[e], span[e] = total[better], ids[lo:hi][better], lens[lo:hi][better]
    on_path = np.zeros(n + units, bool)
    low = at[:-1] + np.arange(units)
    now = at[1:] + np.arange(units)
    live = now > low
    while live.any():
        now, low = now[live], low[live]
        on_path[now] = True
        now = now - span[now]
        live = now > low
    ends = np.flatnonzero(on_path)
    which = np.searchsorted(at[1:] + np.arange(units), ends)
    out, size = how[ends], span[ends]
    if (out < 0).any():
        if m.has_bytes:
            times = np.where(out < 0, size, 1)
            first = ends - size - which
            spread, which_n = np.repeat(out, times), np.repeat(which, times)
            inner = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
            raw = b[np.minimum(np.repeat(first, times) + inner, n - 1)]
            out, which = np.where(spread < 0, m.byte_ids[raw], spread), which_n
        else:
            out = np.where(out < 0, m.unknown_id, out)
    return out.astype(np.int32), np.searchsorted(which, np.arange(units + 1))


def encode_buffers(data: np.ndarray, offsets: np.ndarray, m: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by row) of texts to which the blank was added already."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if not m.whole:
        blank = data == 32
        edge[1:n] |= blank[1:] & ~blank[:-1]
        alone = m.alone[data] & ~blank
        edge[:n] |= alone
        edge[1:] |= alone
    at = np.flatnonzero(edge)
    starts, stops = at[:-1], at[1:]

    def search(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, ends, base = [], [np.zeros(1, np.int64)], 0
        at = np.concatenate([[0], np.cumsum(stops[new] - starts[new])])
        for a, b in kernel.row_slices(at, SEARCHED):
            i, e = viterbi(data[ranges(starts[new[a:b]], np.diff(at[a : b + 1]))], at[a : b + 1] - at[a], m)
            found.append(i)
            ends.append(e[1:] + base)
            base += len(i)
        return np.concatenate(found), np.concatenate(ends)

    place, counts = m.pool.find(kernel.Units(data, starts, stops, kernel.span_hashes(data, starts, stops)), search)
    ids = m.pool.ids[ranges(place, counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ids, ends[np.searchsorted(starts, offsets, "left")]


def with_blank(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARKER, " ")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


def encode(column: pa.Array, m: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by row) of a string column."""
    data, offsets = kernel.buffers(with_blank(column))
    ids, ends, base = [], [np.zeros(1, np.int64)], 0
    for a, b in kernel.row_slices(offsets, kernel.PIECE):
        i, e = encode_buffers(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m)
        ids.append(i)
        ends.append(e[1:] + base)
        base += len(i)
    return np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32), np.concatenate(ends)


def decode(ids: np.ndarray, offsets: np.ndarray, m: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by row): the pieces' bytes, without the blank at each row's start."""
    lengths = m.text_at[ids + 1] - m.text_at[ids]
    data = m.text[ranges(m.text_at[ids], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends[:-1][np.diff(ends) > 0]] = True
    cut = cut[:-1] & (data == 32)
    gone = np.concatenate([[0], np.cumsum(cut)])
    return data[~cut], ends - gone[ends]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared(docs: DataFrame, model_path: str | None) -> object:
    with open(model_path or default_model(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(load(f.read()))  # a model file's size


def encode_column(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    shared = _shared(docs, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                ids, offsets = encode(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, offsets = kernel.buffers(batch.column(1))
    for a, b in kernel.row_slices(offsets):
        yield batch.slice(a, b - a)


def decode_column(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids)."""
    shared = _shared(encoded, model_path)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.if_else(pc.is_null(batch.column(1)), pa.scalar([], pa.list_(pa.int32())), batch.column(1))
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            data, ends = decode(lists.flatten().to_numpy(zero_copy_only=False), offsets, shared.value)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def query(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document, from its ids and the text read back from them: doc_id, n_tokens, n_byte_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_chars, round_trip."""
    shared = _shared(docs, model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _parts(batch):
                ids, offsets = encode(part.column(1), m)
                data, ends = decode(ids, offsets, m)
                raw, raw_at = kernel.buffers(part.column(1))
                raw_ids = ids.astype("<i4")
                byte_sum = np.concatenate([[0], np.cumsum(m.is_byte[ids])])
                head_sum = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                crc = [zlib.crc32(raw_ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                same = [np.array_equal(data[a:b], raw[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], raw_at[:-1], raw_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(byte_sum[offsets])), pa.array(crc, pa.int64()), pa.array(np.diff(head_sum[ends])), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_chars", "round_trip"],
                )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")


def stage(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """The tokens of every document: doc_id, ids."""
    return encode_column(docs, model_path)
