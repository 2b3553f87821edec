"""Benchmark decontamination by spaced seeds that miss no overlap.

Texts are read as lower-case words of letters and digits. An overlap lays the words of item
and document side by side on a diagonal: over all places of the item that have a place in
the document, at least ``min_match`` words must be equal in the best stretch of
``min_words`` words (of all the item's words, where it has fewer).

Seeds are hashes of the words that a fixed mask looks at; the words at its other places are
ignored, so that a substitution there does not matter. The masks of a stretch are chosen so
that wherever its unequal words stand, one of the masks looks at equal words only (tested over
all patterns): items' and documents' seeds are joined on the hash, and the diagonals of the
hits are verified word by word, with substitutions anywhere.

The benchmark is the small side. Up to BROADCAST_WORDS words it is sent to all tasks and
documents stay where they are; beyond, hashes of both sides meet in a shuffle, and only the
documents that hit are read again for verification. Both ways give the same result.

Defined results: a null or empty text, or item, overlaps with nothing; items of one word,
or without an id, are not looked for. Rows without an id are not reported; the stage drops
every row by its own text, whatever its id;
repeated rows are reported once. An empty table gives no rows. Extra
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import kernel

# Masks by the words of a stretch and how many of them may be unequal; 1 looks at a word, 0 ignores it.
MASKS = {
    (2, 0): ("11",),
    (3, 0): ("111",),
    (4, 1): ("111", "1101", "1011"),
    (5, 1): ("1111", "11101", "11011", "10111"),
    (6, 1): ("1111", "11011"),
    (7, 1): ("11111", "111011", "110111"),
    (8, 2): ("11011", "1111", "1100011"),
    (9, 2): ("111011", "1001111", "11010011", "111101"),
    (10, 2): ("111011", "11010011", "11111"),
    (11, 2): ("1110111", "111001011", "1011111", "111111"),
    (12, 3): ("111011", "110100011", "11001011", "110111"),
    (13, 3): ("111011", "1100001011", "110111"),
}
#: Words in a verified stretch, and the least share of them that must be equal.
MIN_WORDS, MIN_MATCH = 13, 0.75
#: Items of one word would be found in every document that has the word.
SHORTEST = 2
#: Hits of seeds that are held at a time.
HITS = 1 << 20
#: Words of the benchmark up to which it is broadcast: 100 bytes each at most, in all.
BROADCAST_WORDS = 2_000_000
_BITS = 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each row)."""
    data, offsets = kernel.buffers(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    parts, firsts, base = [], [np.zeros(1, np.int64)], 0
    for a, b in kernel.row_slices(offsets):
        h, _, _, first = kernel.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sep=kernel.NOT_ALNUM, lower=_SAME)
        parts.append(h)
        firsts.append(first[1:] + base)
        base += len(h)
    return np.concatenate([*parts, np.zeros(0, kernel.U)]), np.concatenate(firsts)


_SAME = np.arange(256, dtype=np.uint8)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the mask's words from each position on; the last len(mask) - 1 positions are left out."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, kernel.U)
    out = np.full(n, int(mask, 2), kernel.U)
    for k, bit in enumerate(mask):
        if bit == "1":
            # odd multipliers of the position: the sum tells order
            out += h[k : k + n] * kernel.U((0x9E3779B97F4A7C15 * (2 * k + 3)) & (2**64 - 1) | 1)
    return kernel.mix(out)


def masks_of(n: int, min_words: int, min_match: float) -> tuple[str, ...]:
    """The masks for an item of n words. Beyond the fixed ones, a run of as many equal words as any accepted stretch has."""
    if n < SHORTEST:
        return ()
    stretch = min(min_words, n)
    # the share that verify() asks for, in whole words
    need = next((x for x in range(1, stretch + 1) if x >= min_match * stretch), stretch)
    return MASKS.get((stretch, stretch - need)) or ("1" * -(-need // (stretch - need + 1)),)


@dataclass
class Benchmark:
    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    #: for each mask: its sorted seeds, with item and position, and a bitmap of their upper bits
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: np.ndarray, words: np.ndarray, first: np.ndarray, min_words: int, min_match: float) -> Benchmark:
        parts: dict[str, list] = {}
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            for mask in masks_of(int(b - a), min_words, min_match):
                parts.setdefault(mask, []).append((seed_hashes(words[a:b], mask), i))
        seeds = {}
        for mask, own in parts.items():
            h = np.concatenate([x for x, _ in own])
            item = np.repeat([i for _, i in own], [len(x) for x, _ in own])
            at = np.concatenate([np.arange(len(x)) for x, _ in own])
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(h >> kernel.U(64 - _BITS)).astype(np.int64)] = True
            seeds[mask] = h[order], item[order], at[order], bitmap
        return Benchmark(ids, words, first, seeds)


def verify(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH) -> tuple[int, int]:
    """(most equal words in a stretch, equal words in all) on the best of the diagonals: word k of the item lies beside word k + d of the document.

    (0, 0) if no stretch has enough.
    """
    stretch = min(min_words, len(item))
    best = (0, 0)
    for d in np.unique(diagonals):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = np.zeros(len(item) + 1, np.int64)
        same[lo + 1 : hi + 1] = item[lo:hi] == doc[lo + d : hi + d]
        total = np.cumsum(same)
        most = int((total[stretch:] - total[:-stretch]).max())
        if most >= min_match * stretch:
            best = max(best, (most, int(total[-1])))
    return best


def find(words: np.ndarray, first: np.ndarray, b: Benchmark, min_words: int, min_match: float) -> list[tuple[int, int, int, int]]:
    """(row, item, most equal words in a stretch, equal words) of all verified overlaps."""
    # rows are laid out with the longest item's words between them, so no two rows share a diagonal
    longest = int(np.diff(b.first).max(initial=0))
    shift = first[:-1] + np.arange(1, len(first)) * longest
    width = len(words) + (len(first) + 1) * longest
    keys = np.zeros(0, np.int64)
    for mask, (seeds, own_item, own_at, bitmap) in b.seeds.items():
        s = seed_hashes(words, mask)
        hit = np.flatnonzero(bitmap[(s >> kernel.U(64 - _BITS)).astype(np.int64)])
        row = np.searchsorted(first, hit, "right") - 1
        inside = hit + len(mask) <= first[row + 1]
        hit, row = hit[inside], row[inside]
        lo, hi = np.searchsorted(seeds, s[hit], "left"), np.searchsorted(seeds, s[hit], "right")
        hit, row, lo, n = hit[hi > lo], row[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        round_of = np.cumsum(n) // HITS
        edges = [0, *(np.flatnonzero(np.diff(round_of)) + 1), len(hit)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            which = kernel.ranges(lo[x:y], n[x:y])
            diagonal = np.repeat(hit[x:y] - first[row[x:y]] + shift[row[x:y]], n[x:y]) - own_at[which]
            keys = np.unique(np.concatenate([keys, own_item[which] * width + diagonal]))
    if not len(keys):
        return []
    item, diagonal = keys // width, keys % width
    # a row's diagonals lie from shift - longest + 1 on
    row = np.searchsorted(shift - longest, diagonal, "left") - 1
    found = np.column_stack([row, item, diagonal - shift[row]])
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    cut = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)]))
    out = []
    for lo, hi in zip(cut, [*cut[1:], len(found)], strict=True):
        row, item = found[lo, :2].tolist()
        most, equal = verify(b.words[b.first[item] : b.first[item + 1]], words[first[row] : first[row + 1]], found[lo:hi, 2], min_words, min_match)
        if most:
            out.append((row, item, most, equal))
    return out


def _hits(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_MATCH}"


_MATCH = "item_id long, matched_stretch long, matched_words long, item_words long"


def _report(batch: pa.RecordBatch, found: list[tuple[int, int, int, int]], b: Benchmark) -> pa.RecordBatch:
    row, item, most, equal = (np.array([x[k] for x in found], np.int64) for k in range(4))
    n = np.diff(b.first)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(b.ids[item]), pa.array(most), pa.array(equal), pa.array(n[item])], ["doc_id", "item_id", "matched_stretch", "matched_words", "item_words"])


def _shared(docs: DataFrame, bench: DataFrame, min_words: int, min_match: float) -> object:
    t = bench.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").toArrow()
    words, first = _words(t["text"].combine_chunks())
    return docs.sparkSession.sparkContext.broadcast(Benchmark.of(t["item_id"].to_numpy(), words, first, min_words, min_match))  # checked: BROADCAST_WORDS


def _broadcast_hits(docs: DataFrame, bench: DataFrame, min_words: int, min_match: float) -> DataFrame:
    shared = _shared(docs, bench, min_words, min_match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            _, offsets = kernel.buffers(batch.column(1))
            for lo, hi in kernel.row_slices(offsets):
                part = batch.slice(lo, hi - lo)
                yield _report(part, find(*_words(part.column(1)), b, min_words, min_match), b)

    return docs.mapInArrow(run, _hits(docs))


def _shuffled_hits(docs: DataFrame, bench: DataFrame, min_words: int, min_match: float) -> DataFrame:
    """The other way, for a benchmark of any size: hashes meet in a shuffle, then the texts of the pairs that hit are verified."""
    lengths = bench.select(F.col("item_id").alias("id"), "text").mapInArrow(_lengths, "n long").distinct()
    # lengths of items, and of a few words the masks
    all_masks = sorted({m for r in lengths.where(F.col("n") <= min_words).collect() for m in masks_of(r.n, min_words, min_match)} | set(masks_of(min_words, min_words, min_match)))

    def seeds(of_bench: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, offsets = kernel.buffers(batch.column(1))
                for lo, hi in kernel.row_slices(offsets, 1 << 20):
                    words, first = _words(batch.column(1).slice(lo, hi - lo))
                    own = [masks_of(n, min_words, min_match) for n in np.diff(first).tolist()] if of_bench else None
                    for mask in all_masks:
                        s = seed_hashes(words, mask)
                        row = np.searchsorted(first, np.arange(len(s)), "right") - 1
                        good = np.arange(len(s)) + len(mask) <= first[row + 1]
                        if of_bench:
                            good &= np.array([mask in x for x in own], bool)[row] if len(row) else good
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row[good])), pa.array(s[good].view(np.int64))], ["id", "seed"])

        return run

    d = docs.select("doc_id", "text").where("doc_id is not null")
    b = bench.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    left = d.mapInArrow(seeds(False), f"id {d.schema['doc_id'].dataType.simpleString()}, seed long").withColumnRenamed("id", "doc_id").distinct()
    right = b.mapInArrow(seeds(True), "id long, seed long").withColumnRenamed("id", "item_id").distinct()
    pairs = left.join(right, "seed").select("doc_id", "item_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(1))
            item_words, item_first = _words(batch.column(3))
            for r in range(len(batch)):
                own = Benchmark.of(batch.column(2).slice(r, 1).to_numpy(), item_words[item_first[r] : item_first[r + 1]], np.array([0, item_first[r + 1] - item_first[r]]), min_words, min_match)
                yield _report(batch.slice(r, 1), find(words[first[r] : first[r + 1]], np.array([0, first[r + 1] - first[r]]), own, min_words, min_match), own)

    return pairs.join(d, "doc_id").join(b, "item_id").select("doc_id", "text", "item_id", "item_text").mapInArrow(run, _hits(d))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, first = _words(batch.column(1))
        n = np.unique(np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(n[n >= SHORTEST])], ["n"])


def overlaps(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, matched_stretch, matched_words, item_words): every document that holds a benchmark item, or a stretch of one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = docs.where("doc_id is not null")
    way = _broadcast_hits if _small(bench, broadcast_words) else _shuffled_hits
    return way(docs, bench, min_words, min_match).groupBy("doc_id", "item_id").agg(F.max("matched_stretch").alias("matched_stretch"), F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return overlaps(docs, bench)


def _small(bench: DataFrame, broadcast_words: int) -> bool:
    """Whether the benchmark has at most that many words: two characters each, with the blank behind it."""
    return (bench.agg(F.sum(F.char_length("text"))).first()[0] or 0) <= 2 * broadcast_words


def stage(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents whose text has no overlap; with a small benchmark they are filtered in place."""
    if not _small(bench, broadcast_words):
        # a text is known by 128 bits of its digest, so ids do not matter
        key = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
        bad = _shuffled_hits(docs.select(key.alias("doc_id"), "text"), bench.select(F.col("item_id").cast("long").alias("item_id"), "text"), min_words, min_match)
        return docs.join(bad.select("doc_id").distinct().withColumnRenamed("doc_id", "_leak"), key == F.col("_leak"), "left_anti")
    shared = _shared(docs, bench, min_words, min_match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            _, offsets = kernel.buffers(text)
            for lo, hi in kernel.row_slices(offsets):
                clean = np.ones(hi - lo, bool)
                clean[[x[0] for x in find(*_words(text.slice(lo, hi - lo)), b, min_words, min_match)]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents) t
), b AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) t WHERE len(w) >= 2
), h AS (
  SELECT doc_id, item_id, n, d.at - b.k AS diagonal, b.k AS k, count(*) OVER (PARTITION BY doc_id, item_id, d.at - b.k) AS equal FROM d JOIN b USING (word)
), r AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS most FROM h WHERE equal >= 0.75 * least(13, n)
)
SELECT doc_id, item_id, max(most) AS matched_stretch, max(equal) AS matched_words, CAST(max(n) AS BIGINT) AS item_words
FROM r WHERE most >= 0.75 * least(13, n) GROUP BY doc_id, item_id
"""
