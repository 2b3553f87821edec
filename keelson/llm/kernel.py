"""Vectorised numpy kernels over Arrow string buffers.

All functions see UTF-8 bytes. Texts are cut into pieces of about PIECE bytes, so
that working memory follows the piece and not the batch or the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled by one round of numpy calls.
PIECE = 1 << 19
#: Places in a unit that have random values of their own; later ones mix the same values once more.
_NEAR = 64


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo


def row_slices(offsets: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_VALUES = mix(np.arange(1, _NEAR * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(-1)


def _sums_of(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums over b of a random number for each byte and its place in its unit; starts are those of the units, ascending.

    Tabulation: no algebra between places, so no pattern of bytes makes two units meet but by chance.
    """
    step = np.zeros(len(b), np.int32)
    if len(starts):
        step[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(b), dtype=np.int32) - np.cumsum(step, dtype=np.int32)
    far = np.flatnonzero(place >= _NEAR)
    values = _VALUES[((place & (_NEAR - 1)) << 8) + b]
    if len(far):
        values[far] = mix(values[far] ^ ((place[far] // _NEAR).astype(U) * U(0xA0761D6478BD642F)))
    total = np.empty(len(b) + 1, U)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    return total


def table(members: bytes | set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = table(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but letters and digits.
NOT_ALNUM = table({i for i in range(128) if not chr(i).isalnum()})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that end after a separator or at a row's end; a longer word stays whole."""
    total, lo = len(data), 0
    while lo < total:
        hi = min(lo + PIECE, total)
        if hi < total:
            row_end = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = row_end if row_end > lo else 0
            back = np.flatnonzero(sep[data[max(lo, hi - 4096) : hi]])
            cut = max(cut, max(lo, hi - 4096) + int(back[-1]) + 1 if len(back) else 0)
            if cut <= lo:
                next_end = int(offsets[np.searchsorted(offsets, hi, "left")])
                ahead = np.flatnonzero(sep[data[hi:next_end]])
                cut = hi + int(ahead[0]) + 1 if len(ahead) else next_end
            hi = cut
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACES, lower: np.ndarray = LOWER, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first) of all words: byte ranges in data; first[r] is the number of words before row r. ``cuts``: positions where words are cut too.

    Hashes are of the word's bytes after ``lower``; equal words have equal hashes in any process.
    """
    hashes, starts, ends = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    for lo, hi in pieces(data, offsets, sep):
        b = data[lo:hi]
        inside = ~sep[b]
        fresh = edge[lo:hi].copy()
        fresh[0] = True
        fresh[1:] |= ~inside[:-1]
        s = np.flatnonzero(inside & fresh)
        stop = np.empty(hi - lo, bool)
        stop[-1] = True
        stop[:-1] = fresh[1:] | ~inside[1:]
        e = np.flatnonzero(inside & stop) + 1
        total = _sums_of(lower[b], s)
        hashes.append(mix(total[e] - total[s] + (e - s).astype(U)))
        starts.append(s + lo)
        ends.append(e + lo)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    h, s, e = cat(hashes, U), cat(starts, np.int64), cat(ends, np.int64)
    return h, s, e, np.searchsorted(s, offsets, "left")


_STEP = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on (the last n - 1 positions are left out)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m] * _STEP[0]
    for k in range(1, n):
        out = mix(out) + h[k : k + m] * _STEP[k % 5]
    return mix(out + U(n))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges data[starts[i]:ends[i]], as they are; ranges ascend and do not overlap."""
    total = _sums_of(data, starts)
    return mix(total[ends] - total[starts] + (ends - starts).astype(U))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 for all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@dataclass
class Units:
    """Byte ranges of a text that a pool is asked for, with their hashes; ranges ascend and do not overlap."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.hashes = np.where(self.hashes == 0, U(1), self.hashes)
        self.size = self.ends - self.starts
        #: The first and the last 8 bytes (of shorter units the whole, then zeros): with the size they are a unit of up to 16 bytes.
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        words = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        self.head = words[self.starts] & _LOW[np.minimum(self.size, 8)]
        self.tail = words[np.maximum(self.ends - 8, self.starts)] & _LOW[np.minimum(self.size, 8)]

    def bytes_of(self, which: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[which], self.size[which])]


_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


class Pool:
    """Ids of the distinct units that a worker met; forgets all beyond ``limit`` units or ``room`` bytes of long units.

    An open hash table in numpy arrays, probed for all keys in step. A hit counts only if the units' bytes are the same;
    a unit that meets another one's hash is encoded on its own.
    """

    def __init__(self, limit: int = 1_000_000, room: int = 1 << 26) -> None:
        self.limit, self.room = limit, room
        self.clear()

    def clear(self) -> None:
        self.units = self.used = self.long_used = 0
        self.keys, self.where = np.zeros(1 << 17, U), np.zeros(1 << 17, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros((1 << 16, 3), np.int64)  # of ids: start, length; start of a long unit's bytes
        self.size, self.head, self.tail = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, U), np.zeros(1 << 16, U)
        self.long = np.zeros(1 << 16, np.uint8)

    def __reduce__(self) -> tuple:
        return Pool, (self.limit, self.room)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty slot where its search ends."""
        mask = len(self.keys) - 1
        slot = (keys >> U(64 - mask.bit_length())).astype(np.int64)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
        return slot

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        while len(keys):
            slot = self._slots(keys)
            _, first = np.unique(slot, return_index=True)  # of keys that end at one slot, one gets it
            self.keys[slot[first]], self.where[slot[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def _append(self, ids: np.ndarray) -> int:
        """Where ids are kept from now on."""
        start = self.used
        self.ids = _grown(self.ids, start + len(ids))
        self.ids[start : start + len(ids)] = ids
        self.used += len(ids)
        return start

    def _add(self, units: Units, new: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        ids, at = encode(new)
        n, m = self.units, self.units + len(new)
        self.at, self.size, self.head, self.tail = (_grown(x, m) for x in (self.at, self.size, self.head, self.tail))
        if 2 * m > len(self.keys):
            held = self.keys != 0
            old, values = self.keys[held], self.where[held]
            size = 1 << (4 * m).bit_length()
            self.keys, self.where = np.zeros(size, U), np.zeros(size, np.int32)
            self._put(old, values)
        self.at[n:m, 0] = at[:-1] + self._append(ids)
        self.at[n:m, 1] = np.diff(at)
        self.size[n:m], self.head[n:m], self.tail[n:m] = units.size[new], units.head[new], units.tail[new]
        bytes_ = np.where(units.size[new] > 16, units.size[new], 0)
        self.at[n:m, 2] = self.long_used + np.cumsum(bytes_) - bytes_
        body = units.bytes_of(new[bytes_ > 0])
        self.long = _grown(self.long, self.long_used + len(body))
        self.long[self.long_used : self.long_used + len(body)] = body
        self.long_used += len(body)
        self.units = m
        self._put(units.hashes[new], np.arange(n, m, dtype=np.int32))

    def _other(self, units: Units, found: np.ndarray) -> np.ndarray:
        """The units whose bytes are not those of the unit found for them."""
        bad = (self.head[found] != units.head) | (self.tail[found] != units.tail) | (self.size[found] != units.size)
        long = np.flatnonzero((units.size > 16) & ~bad)
        if len(long):
            n = units.size[long]
            apart = self.long[ranges(self.at[found[long], 2], n)] != units.bytes_of(long)
            bad[long[np.add.reduceat(apart, np.cumsum(n) - n) > 0]] = True
        return np.flatnonzero(bad)

    def find(self, units: Units, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(start in self.ids, length) for each unit; ``encode`` gets places of units, and returns their ids and offsets."""
        slot = self._slots(units.hashes)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            _, first = np.unique(units.hashes[new], return_index=True)
            new = new[first]
            if self.units and (self.units + len(new) > self.limit or self.long_used + int(units.size[new].sum()) > self.room):
                self.clear()
                return self.find(units, encode)
            self._add(units, new, encode)
            slot = self._slots(units.hashes)
        found = self.where[slot]
        start, length = self.at[found, 0], self.at[found, 1]
        odd = self._other(units, found)
        if len(odd):
            ids, at = encode(odd)
            start[odd], length[odd] = at[:-1] + self._append(ids), np.diff(at)
        return start, length


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n rows."""
    if n <= len(x):
        return x
    return np.concatenate([x, np.zeros((max(len(x), n - len(x)), *x.shape[1:]), x.dtype)])
