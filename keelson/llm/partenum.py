"""N-gram Jaccard join by PartEnum signatures, exact, up to connected components.

A text's set are its distinct shingles of ``n`` words. Sizes are cut into bands; a band and
the sizes that sets of the band can link with form an instance. In an instance linked sets
differ in at most k shingles. PartEnum cuts the domain of shingles into n1 partitions, each
into n2 = 2 smaller ones, and gives a set a signature for every choice of n2 - 1 of the smaller
ones in each partition: the hash of its shingles there. With k + 1 + spare smaller partitions in
all, linked sets have spare + 1 signatures in common at least, so each set may leave out spare of
its own, if all sets leave out those that come first in one order of all signatures. The order
puts first what is common: partitions in which a set has nothing, then signatures that many
texts have (a passage that they share fills a partition). Half of the spare ones go before
signatures are shuffled, by counts in a table of fixed size that all tasks share; the others go
by exact counts, when runs are known: so sets become candidates only if they share more
signatures than a passage gives them. Orders change the work, never the result.

Texts with equal sets are one class from the start. Classes that share a signature are
candidates. Not all pairs of such a run are made: first each class is compared with one other,
the least of the first classes of its runs, and what links becomes a component. Where a run
has more than one component, each class outside the largest is compared with some classes of
that, others and more each round: every run names one by chance, and those that most of its runs
name come first, since they share most with it; where then still is more than one component,
with all the rest, across components only. Candidates are pruned without loss by size and by parity sketches (two sets
differ in at least as many shingles as their sketches in bits), and the others verified on the
shingles themselves: a link needs 100 * intersection >= percent * union, in whole numbers.
Runs of signatures that the table knows as hot are dealt out in parts.

Sets are known by 64-bit hashes of shingles (40 bits where two sets are compared) and of the
whole set; a second hash tells if two sets met in one, which is an error.

Defined results: a null text, or one without words, has an empty set and links with nothing;
with fewer than n words the whole sequence is one shingle. Repeated rows each have a result.
A row without an id has that of its class. An empty table gives no rows. Extra columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm import kernel
from keelson.llm.common import discard, materialize, small_batches

U = kernel.U
#: Signatures that a set may leave out are so many and half as many as linked sets may differ in shingles; ratio of a band's ends.
MORE, WIDTH = 3, 1.3
#: Upper bits of a signature that the table of counts goes by; powers of two of a count from which a run is dealt out in parts.
BITS, SPLIT = 22, 10
# A signature's lowest bits: 7 have its band, one tells if it is hot, 4 have the part that it is dealt out to.
_BAND, _HOT, _PART_AT, _PART = 127, 128, 8, 15 << 8
N2, K2 = 2, 1
#: Least bits of the sketch that pairs are pruned by before their shingles are read; it grows with the set.
WIDE = 1024
#: Rounds, by how many classes of its runs' largest components a class outside them is compared with.
ROUNDS = (8, 32)
#: Candidates for each row of the mixed runs up to which no further round is worth its while.
FEW = 8
#: Candidate classes whose ids are broadcast at most (16 bytes each); with more of them, texts join them in a shuffle.
BROADCAST_CLASSES = 1_000_000
#: Links between classes up to which the driver finds components (16 bytes each); of more of them, alternating stars do.
FEW_EDGES = 1_000_000


def bands(largest: int) -> np.ndarray:
    """First sizes of the bands, up to one beyond the largest size."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * WIDTH))))
    return np.array(out)


def plan(top: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smaller partitions, signatures left out early, and later) for bands up to the sizes ``top``."""
    k = top * (100 - percent) // percent
    # sets that may not differ at all have one signature: all their shingles
    parts = np.where(k > 0, -(-(k + 1 + MORE + k // 2) // (K2 + 1)) * N2, 1)
    spare = parts - k - 1
    return parts, spare // 2, spare - spare // 2


def instances(size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, instance) of sets of the sizes, in turns: a set is in its own band's instance and in those of lower bands that reach up to it."""
    edges = bands(int(size.max(initial=1)))
    own = np.searchsorted(edges, size, "right") - 1
    back = 0
    while True:
        band = own - back
        rows = np.flatnonzero((band >= 0) & (size > 0) & (size * percent <= (edges[np.maximum(band, 0) + 1] - 1) * 100))
        if not len(rows):
            return
        yield rows, band[rows]
        back += 1


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, offsets by row) by slices of rows; shingles are distinct and ascending in each row."""
    data, offsets = kernel.buffers(column)
    for lo, hi in kernel.row_slices(offsets, 1 << 21):
        h, _, _, first = kernel.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        count = np.diff(first)
        full = kernel.shingles(h, n)
        row = np.repeat(np.arange(hi - lo), count)[: len(full)]
        inside = np.arange(len(full)) + n <= first[row + 1]
        full, row = full[inside], row[inside]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            full = np.concatenate([full, *(kernel.shingles(h[first[r] : first[r + 1]], int(count[r])) for r in short)])
            row = np.concatenate([row, short])
        order = np.lexsort((full, row))
        full, row = full[order], row[order]
        if len(full):
            fresh = np.concatenate([[True], (full[1:] != full[:-1]) | (row[1:] != row[:-1])])
            full, row = full[fresh], row[fresh]
        yield lo, full, np.searchsorted(row, np.arange(hi - lo + 1))


def _sums(values: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, U)
    np.add.at(out, key, values)
    return out


def class_hash(shingles: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    n = np.diff(at)
    return kernel.mix(_sums(kernel.mix(shingles ^ U(salt)), np.repeat(np.arange(len(n)), n), len(n)) + n.astype(U))


def _parts(shingles: np.ndarray, at: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, owner, rank in the owner, left out early by owner, signature, whether empty) of all smaller partitions, at most 65,536 owners at a time."""
    place, mixed = kernel.mix(shingles ^ U(0x5851F42D4C957F2D)), kernel.mix(shingles ^ U(0x14057B7EF767814F))
    size = np.diff(at)
    edges = bands(int(size.max(initial=1)))
    for all_rows, all_bands in instances(size, percent):
        for lo in range(0, len(all_rows), 1 << 16):
            rows, band = all_rows[lo : lo + (1 << 16)], all_bands[lo : lo + (1 << 16)]
            parts, early, _ = plan(edges[band + 1] - 1, percent)
            n = size[rows]
            which = kernel.ranges(at[rows], n)
            base = np.cumsum(parts) - parts
            key = np.repeat(base, n) + (place[which] % np.repeat(parts, n).astype(U)).astype(np.int64)
            total = int(parts.sum())
            owner = np.repeat(np.arange(len(rows)), parts)
            rank = np.arange(total) - base[owner]
            mark = (band[owner].astype(U) << U(40)) + rank.astype(U) + U(1)
            sig = kernel.mix(_sums(mixed[which], key, total) + kernel.mix(mark))
            yield rows, owner, rank, early, sig & ~U(_BAND | _HOT | _PART) | band[owner].astype(U), np.bincount(key, minlength=total) == 0


def signatures(shingles: np.ndarray, at: np.ndarray, percent: int, levels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, signature, level), instance by instance: without those left out early, that come first by level (of the table; 15: empty), then signature."""
    for rows, owner, rank, early, sig, empty in _parts(shingles, at, percent):
        level = np.zeros(len(sig), U) if levels is None else levels[(sig >> U(64 - BITS)).astype(np.int64)].astype(U)
        level[empty] = 15
        key = owner.astype(U) << U(48) | (U(15) - level) << U(44) | sig >> U(20)
        order = np.argsort(key)
        found = key[order]
        if (found[1:] == found[:-1]).any():  # the lowest bits decide
            order = np.lexsort((sig, U(15) - level, owner))
        kept = order[rank >= early[owner]]  # owners keep their places in the order
        yield rows[owner[kept]], sig[kept], level[kept].astype(np.int64)


def sketch(shingles: np.ndarray, at: np.ndarray, bits: int = 256) -> np.ndarray:
    """Words of ``bits`` (a power of two) parity bits for each row."""
    n = np.diff(at)
    bit = kernel.mix(shingles ^ U(0x2545F4914F6CDD1D)) >> U(64 - bits.bit_length() + 1)
    odd = np.zeros((len(n), bits), np.uint8)
    for lo in range(0, len(n), 256):  # some rows at a time: counts are wide
        hi = min(lo + 256, len(n))
        own = np.repeat(np.arange(hi - lo), n[lo:hi]) * bits + bit[at[lo] : at[hi]].astype(np.int64)
        odd[lo:hi] = np.bincount(own, minlength=(hi - lo) * bits).reshape(hi - lo, bits) & 1
    return np.packbits(odd, axis=1).view(np.int64).reshape(len(n), bits // 64)


def wide_sketches(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bits, as many as shingles or more (a power of two). Half the bits of a sketch are the XOR of its halves, so any two compare."""
    place = kernel.mix(shingles ^ U(0x2545F4914F6CDD1D)).astype(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = max(WIDE, 1 << (b - a - 1).bit_length() if b > a else 1)
        out.append(np.packbits((np.bincount(place[a:b] & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def sketch_difference(x: bytes, y: bytes) -> int:
    """How many bits of two wide sketches differ, at the size of the smaller; sets differ in as many shingles at least."""
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, class (null without shingles), check, s0..s3 and wide (sketches of 256 bits, and by size) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, shingles, at in sets_of(batch.column(1), n):
                size = np.diff(at)
                h, h2, s = class_hash(shingles, at, 1), class_hash(shingles, at, 2), sketch(shingles, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(size)), pa.array(size), pa.array(h.view(np.int64), mask=size == 0), pa.array(h2.view(np.int64)), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(4)), pa.array(wide_sketches(shingles, at), pa.binary())], ["doc_id", "n_shingles", "class", "check", "s0", "s1", "s2", "s3", "wide"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class long, check long, s0 long, s1 long, s2 long, s3 long, wide binary")


def _distinct_sets(batch: pa.RecordBatch, n: int, often: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class, shingles, offsets) by slices of the rows (doc_id, text); the rows of a class that has another row in the slice, or elsewhere its owner, are empty."""
    classes, owners = often
    for lo, shingles, at in sets_of(batch.column(1), n):
        h = class_hash(shingles, at, 1)
        own = np.zeros(len(h), bool)
        own[np.unique(h, return_index=True)[1]] = True
        if len(classes):
            spot = np.minimum(np.searchsorted(classes, h.view(np.int64)), len(classes) - 1)
            ids = batch.column(0).slice(lo, len(h)).fill_null(_NO_ID).to_numpy()
            known = classes[spot] == h.view(np.int64)
            own = np.where(known, False, own)
            chosen = np.flatnonzero(known & (owners[spot] == ids))
            own[chosen[np.unique(h[chosen], return_index=True)[1]]] = True
        yield h, shingles[np.repeat(own, np.diff(at))], np.concatenate([[0], np.cumsum(np.where(own, np.diff(at), 0))])


def _often(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(class, owner) of the classes of many rows, that the owner's rows alone speak for. Their number is bounded: each has a BROADCAST_CLASSES-th of all rows."""
    rows = classes.agg(F.sum("copies")).first()[0] or 0
    t = classes.where(F.col("copies") >= max(64, rows // BROADCAST_CLASSES) if BROADCAST_CLASSES else F.lit(False)).select("class", F.coalesce("owner", F.lit(_NO_ID)).alias("owner")).toArrow()
    order = np.argsort(t["class"].to_numpy())
    return t["class"].to_numpy()[order], t["owner"].to_numpy()[order]


def common_levels(docs: DataFrame, often: object, n: int, percent: int) -> np.ndarray:
    """For the upper BITS of a signature how common it is: bits of a count, 14 at most. Tasks count all of theirs, and tell what stands out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for _, shingles, at in _distinct_sets(batch, n, often.value):
                for *_, sig, empty in _parts(shingles, at, percent):
                    np.add.at(table, (sig[~empty] >> U(64 - BITS)).astype(np.int64), np.uint32(1))
        mean = table.mean()
        found = np.flatnonzero(table > mean + 4 * np.sqrt(mean) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(table[found].astype(np.int64))], ["at", "n"])

    counts = docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # two numbers for each of 2 ** BITS places at most
    out = np.zeros(1 << BITS, np.uint8)
    out[counts["at"].to_numpy()] = np.minimum(14, np.frexp(counts["n"].to_numpy().astype(np.float64))[1])
    return out


def posts(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, class) of all classes; a class may have its own more than once. Common signatures are marked as hot, and dealt out in parts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = docs.sparkSession.sparkContext.broadcast(_often(classes))  # BROADCAST_CLASSES rows of two numbers at most
    levels = docs.sparkSession.sparkContext.broadcast(common_levels(docs, often, n, percent))  # 2 ** BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, shingles, at in _distinct_sets(batch, n, often.value):
                for row, sig, level in signatures(shingles, at, percent, levels.value):
                    own = h[row]
                    part = own & ((U(1) << np.maximum(0, level - SPLIT).astype(U)) - U(1)) & U(_PART >> _PART_AT)
                    sig = sig | np.where(level > SPLIT, U(_HOT) | part << U(_PART_AT), U(0))
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(own.view(np.int64))], ["sig", "class"])

    return docs.mapInArrow(run, "sig long, class long")


def shared_runs(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, class, first) of the runs of two classes or more; first is a run's least class. Each class has left out what it may."""
    run, hot = W.partitionBy("sig"), F.col("sig").bitwiseAND(_HOT) != 0
    runs = posts(docs, classes, n, percent).withColumn("n", F.count(F.lit(1)).over(run)).withColumn("first", F.min("class").over(run)).withColumn("last", F.max("class").over(run))
    runs = materialize(runs.where(hot | (F.col("first") < F.col("last"))).select("sig", "class", "n"), "runs")
    # a hot run's count is that of its parts
    dealt = runs.where(hot).select(F.col("sig").bitwiseAND(~_PART).alias("sig"), "class")
    whole = materialize(dealt.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "hot")
    both = runs.where(~hot).unionByName(dealt.join(whole, "sig"))
    # what a class may leave out by exact counts
    largest = int(classes.agg(F.max("n_shingles")).first()[0] or 1)
    later = plan(bands(largest)[1:] - 1, percent)[2]
    band = F.col("sig").bitwiseAND(_BAND).cast("int").alias("band")
    both = both.select("sig", "class", "n", band).repartition("class", "band").groupBy("class", "band", "sig").agg(F.max("n").alias("n"))
    order = F.row_number().over(W.partitionBy("class", "band").orderBy(F.desc("n"), "sig"))
    kept = both.withColumn("at", order).where(F.col("at") > F.element_at(F.array(*map(F.lit, later.tolist())), F.col("band") + 1)).select("sig", "class")
    kept = materialize(kept, "kept")
    discard(runs, whole)
    ends = materialize(kept.groupBy("sig").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select("sig", "first"), "ends")
    shared = materialize(kept.join(ends, "sig"), "shared")
    discard(kept, ends)
    return shared


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, members): the 40-bit shingles of the wanted classes, read from the text of their document ``owner``."""
    count = wanted.count()

    def emit(batch: pa.RecordBatch, known: tuple | None) -> Iterator[pa.RecordBatch]:
        for lo, shingles, at in sets_of(batch.column(1), n):
            h = class_hash(shingles, at, 1).view(np.int64)
            rows = np.flatnonzero(np.diff(at) > 0)
            if known is not None:
                classes, owners = known
                spot = np.minimum(np.searchsorted(classes, h[rows]), max(0, len(classes) - 1))
                ids = batch.column(0).slice(lo, len(h)).fill_null(_NO_ID).to_numpy()
                rows = rows[(classes[spot] == h[rows]) & (owners[spot] == ids[rows])] if len(classes) else rows[:0]
            low = shingles & U(_MASK)
            body = [np.unique(low[at[r] : at[r + 1]]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(body, pa.binary())], ["class", "members"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if count <= BROADCAST_CLASSES:
        table = wanted.select("class", F.coalesce("owner", F.lit(_NO_ID)).alias("owner")).toArrow()
        c, o = table["class"].to_numpy(), table["owner"].to_numpy()
        order = np.argsort(c)
        shared = docs.sparkSession.sparkContext.broadcast((c[order], o[order]))  # checked: BROADCAST_CLASSES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from emit(batch, shared.value)

        found = ids.mapInArrow(run, "class long, members binary")
    else:
        owners = wanted.select(F.coalesce("owner", F.lit(_NO_ID)).alias("owner")).distinct()
        texts = ids.join(owners, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("owner"), "left_semi")

        def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from emit(batch, None)

        found = texts.mapInArrow(run_all, "class long, members binary").join(wanted.select("class"), "class", "left_semi")
    return found.dropDuplicates(["class"])


_NO_ID, _MASK = -(1 << 63), (1 << 40) - 1


def _five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def read_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    wanted = materialize(nodes.distinct().join(classes.select("class", "owner"), "class"), "wanted")
    return materialize(class_sets(docs, wanted, n), "sets")


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of classes that link, by their shingles: of ``sets``, or read anew for the classes of the pairs."""
    wide = classes.select("class", "wide", "n_shingles")
    pairs = pairs.join(wide.toDF("a", "wide_a", "n_a"), "a").join(wide.toDF("b", "wide_b", "n_b"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, wide_a, wide_b, total = batch.columns
            apart = np.array([sketch_difference(x, y) for x, y in zip(wide_a.to_pylist(), wide_b.to_pylist(), strict=True)], np.int64)
            mask = pa.array(apart * (100 + percent) <= total.to_numpy() * (100 - percent))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    pairs = materialize(pairs.select("a", "b", "wide_a", "wide_b", F.expr("n_a + n_b")).mapInArrow(near, "a long, b long"), "near")
    if sets is None:
        sets = read_sets(docs, pairs.select(F.col("a").alias("class")).union(pairs.select("b")), classes, n)
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("members").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, xs, ys = batch.columns
            good = []
            for x, y in zip(xs, ys, strict=True):
                x, y = _five(x.as_py()), _five(y.as_py())
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _close(percent: int) -> Column:
    """Whether size and sketch leave room for a link; columns of the two sides end in _a and _b."""
    bits = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(4)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (bits * (100 + percent) <= total * (100 - percent))


def _side(classes: DataFrame, end: str) -> list[Column]:
    return [F.col("class").alias(end), F.col("n_shingles").alias(f"n_{end}"), *(F.col(f"s{k}").alias(f"s{k}_{end}") for k in range(4))]


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of the edges (a, b). Roots with a smaller neighbour hook on to it, so that at most half are left each round."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b). Up to FEW_EDGES in the driver; beyond by alternating stars, each round written to the shared folder."""

    used: list[DataFrame] = []

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("b", "a"))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # written, so that both sides of the join are dealt out for it alone and a hot node can be split
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        used.append(least)
        joined = e.join(least, "a")
        if large:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()

    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = sign(now)
    if 0 < before[0] <= FEW_EDGES:
        few = now.toArrow()  # checked: FEW_EDGES
        nodes, roots = least_reachable(few["a"].to_numpy(), few["b"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}))
    while before[0]:
        used.append(now)
        now = materialize(star(star(now, True), False), "edges")
        discard(*used)  # the round is written
        used.clear()
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) after more edges (a, b): the components' roots alone are joined anew."""
    ends = found.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    up = materialize(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "up")
    new = up.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(new).join(up.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def links(docs: DataFrame, table: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) of all classes that link with another."""
    classes = materialize(
        table.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("check").alias("lo"), F.max("check").alias("hi"), *(F.min(f"s{k}").alias(f"s{k}") for k in range(4)), F.min("wide").alias("wide")),
        "classes",
    )
    if classes.where("lo != hi").limit(1).count():
        raise ValueError("two sets of shingles have the same hash")
    shared = shared_runs(docs, classes, n, percent)

    def pruned(pairs: DataFrame) -> DataFrame:
        return pairs.join(classes.select(*_side(classes, "a")), "a").join(classes.select(*_side(classes, "b")), "b").where(_close(percent)).select("a", "b")

    # one partner for each class
    tested = materialize(pruned(shared.where(F.col("class") != F.col("first")).groupBy(F.col("class").alias("b")).agg(F.min("first").alias("a"))), "pairs")
    linked = materialize(verify(docs, tested, classes, n, percent), "links")
    roots = materialize(components(linked), "roots")
    # some more at a time across components, while that joins some; then all that is left
    apart = materialize(_mixed(shared.select("sig", "class"), roots).select("sig", "class"), "mixed")
    sets = read_sets(docs, apart.select("class"), classes, n)
    for turn, most in enumerate([*ROUNDS, None]):
        mixed = materialize(_mixed(apart, roots), "mixed")
        rows, work = mixed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("root") != F.col("main"), 1)).alias("out")).agg(F.sum("n"), F.sum(F.col("n") * F.col("out"))).first()
        every = most is None or (work or 0) <= FEW * (rows or 0)
        pairs = _across(mixed, classes, percent) if every else pruned(_picked(mixed, turn, most))
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        discard(mixed)
        if pairs.limit(1).count():
            tested = tested.union(pairs)
            found = materialize(verify(docs, pairs, classes, n, percent, sets), "links")
            if found.limit(1).count():
                roots = materialize(joined(roots, found), "roots")
        if every:
            return roots
    raise AssertionError("the last round compares all")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, class, root, main) of runs (sig, class) with more than one component; main is the largest one's root."""
    members = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = members.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("sig").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("sig", "main")
    return members.join(materialize(mixed, "mixed"), "sig")  # written: a hot run can be split


def _picked(mixed: DataFrame, turn: int, most: int) -> DataFrame:
    """For each class outside the largest component of its runs up to ``most`` classes (a, b) of such components: each run names one, others each turn."""
    order = F.xxhash64(F.col("class"), F.col("sig"), F.lit(turn))
    chosen = mixed.where("root = main").groupBy("sig").agg(F.min(F.struct(order.alias("h"), F.col("class").alias("y")))["y"].alias("y"))
    named = mixed.where("root != main").join(chosen, "sig").groupBy(F.col("class").alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct("n", F.xxhash64("x", "y").alias("h"), "y")), asc=False)  # as many as a class has signatures
    one = named.groupBy("x").agg(F.slice(ranked, 1, most).alias("ys")).select("x", F.explode("ys.y").alias("y"))
    return one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _across(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All candidates (a, b) of mixed runs: what is outside the largest component against the rest, across components."""
    members = materialize(mixed.join(classes.select("class", "n_shingles", "s0", "s1", "s2", "s3"), "class"), "across")
    a = members.where("root != main").select("sig", F.col("root").alias("root_a"), *_side(members, "a"))
    b = members.select("sig", F.col("root").alias("root_b"), (F.col("root") == F.col("main")).alias("in_main"), *_side(members, "b"))
    across = a.join(b, "sig").where((F.col("root_a") != F.col("root_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _close(percent))
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class, component_id of each row: the smallest doc_id reachable by links."""
    docs = small_batches(docs)
    table = materialize(prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n), "prints")
    roots = materialize(links(docs, table, n, percent), "roots")
    owners = table.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("owner"))
    rooted = owners.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    return table.join(named, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    return groups(docs, n, percent).drop("class")


def stage(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that with the smallest id. Rows without an id stay."""
    gone = materialize(groups(docs, n, percent).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_CLASSES:  # checked; else texts and ids meet in a shuffle
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), p AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a
), least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.b, s.doc_id)) AS component_id FROM s LEFT JOIN least_of c ON c.a = s.doc_id
"""
