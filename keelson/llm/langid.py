"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams (n = 3 and 4,
ASCII lower case, everything in ASCII but letters read as a blank). Embeddings and the
softmax are trained together by stochastic gradient descent in numpy. As averaging and
the softmax's argument are linear, a trained model folds to one table of logits per
bucket, which executors apply to whole texts. Probabilities are calibrated by a
temperature on rows kept from training.

A text is rejected whose n-grams are too often in no learning row. How often is usual comes
from the learning rows, each held against all others: a text may have REJECT_FACTOR times
the unknown share that all but one in a hundred of them stay below. SMOOTH known n-grams
are added to each text, so a name or two in a short text do not count as another language.

Defined results: a null text, an empty one or one without a letter gives ``und``, score 0
and is rejected. A rejected text with letters still names its likeliest language. Where
learning rows have little in common (a few rows), only letterless texts are rejected. Rows with a null id are predicted like others and count as the empty id
for the fold. Repeated rows are each predicted. Without a row to learn from, all is ``und``.
Extra columns do not matter; with a clashing name they are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm import kernel
from keelson.llm.common import crc_mod, small_batches

NGRAMS = (3, 4)
BITS = 13
BUCKETS = 1 << BITS
#: Width of the hash that tells known n-grams; its upper bits are the bucket.
KNOWN_BITS = 20
SMOOTH, REJECT_FACTOR = 20, 3
UNKNOWN = "und"
#: Labelled rows per language that training uses at most.
SAMPLE_PER_LANG = 300
_CODE = np.where((np.arange(256) >= 128) | (kernel.LOWER >= 97) & (kernel.LOWER <= 122), kernel.LOWER, 32).astype(np.uint32)

_NONE = len(NGRAMS) << KNOWN_BITS


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, hash at each byte for each n) by pieces; the hash _NONE stands for none. A hash shifted by KNOWN_BITS - BITS is a bucket."""
    for lo in range(0, len(data), kernel.PIECE):
        hi = min(lo + kernel.PIECE, len(data))
        ext = np.full(hi - lo + max(NGRAMS), 32, np.uint32)
        part = data[lo : min(hi + max(NGRAMS), len(data))]
        ext[: len(part)] = _CODE[part]
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (lo, hi - 1))
        row = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], lo, hi)))
        left = offsets[row + 1] - np.arange(lo, hi)
        n = hi - lo
        key = ext[:n] | ext[1 : n + 1] << np.uint32(8)
        out = np.empty((len(NGRAMS), n), np.int64)
        for k, size in enumerate(NGRAMS):
            key = key | ext[size - 1 : size - 1 + n] << np.uint32(8 * (size - 1))
            h = (key * np.uint32(0x9E3779B1)) ^ (key >> np.uint32(15))
            h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - KNOWN_BITS)
            blank = int("20" * size, 16)
            out[k] = np.where((left >= size) & (key != blank), h.astype(np.int64) + (k << KNOWN_BITS), _NONE)
        yield lo, row, out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (_CODE[data] != 32) & (data < 128)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    out = (count[offsets[1:]] - count[offsets[:-1]]) > 0
    for r in np.flatnonzero(~out & ((wide[offsets[1:]] - wide[offsets[:-1]]) > 0)):
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _summed(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, sum of their counts)."""
    at, which = np.unique(at, return_inverse=True)
    return at, np.bincount(which, count, len(at)).astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        data, offsets = kernel.buffers(t["text"])
        packed = []
        for r in range(len(t)):
            own = data[offsets[r] : offsets[r + 1]]
            at, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _, _, g in _grams(own, np.array([0, len(own)])):
                more, n = np.unique(g[g != _NONE], return_counts=True)
                at, count = _summed(np.concatenate([at, more]), np.concatenate([count, n]))
            packed.append(np.concatenate([at, count]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([t["lang"].combine_chunks().cast(pa.string()), pa.array(packed, pa.binary())], ["lang", "grams"])


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (buckets + 1, languages), float32; the last row is zero
    bias: np.ndarray
    temperature: float
    #: whether the n-gram of a hash is in a learning row; false for _NONE
    known: np.ndarray
    #: the least share of known n-grams
    reject_below: float


def training_rows(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(lang, grams) of at most per_lang labelled rows per language, chosen by a hash of the id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_lang).select("doc_id").distinct()
    # per_lang ids for each language: small by the bound above
    return labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text").mapInArrow(_histograms, "lang string, grams binary")


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, dim: int = 16, epochs: int = 12, seed: int = 7) -> Model:
    rows = sorted((r.lang, bytes(r.grams)) for r in training_rows(docs, per_lang).collect())
    langs = sorted({r[0] for r in rows})
    width = len(NGRAMS) * BUCKETS
    if not langs:
        return Model([], np.zeros((width + 1, 0), np.float32), np.zeros(0), 1.0, np.zeros(_NONE + 1, bool), 1.0)
    y = np.array([langs.index(r[0]) for r in rows])
    sparse, grams = [], []
    for _, raw in rows:
        flat = np.frombuffer(raw, np.uint32)
        grams.append((flat[: len(flat) // 2], flat[len(flat) // 2 :]))
        at, count = _summed(grams[-1][0] >> np.uint32(KNOWN_BITS - BITS), grams[-1][1])
        sparse.append((at, (count / max(1.0, count.sum())).astype(np.float32)))
    holders = np.bincount(np.concatenate([at for at, _ in grams]).astype(np.int64), minlength=_NONE + 1)
    shares = [_known_share(count[holders[at] > 1].sum(), count.sum()) for at, count in grams]
    reject_below = max(0.0, 1 - REJECT_FACTOR * (1 - float(np.quantile(shares, 0.01, method="lower"))))

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept = order[: len(rows) // 5] if len(rows) >= 20 else order
    used = order[len(rows) // 5 :] if len(rows) >= 20 else order
    e = rng.uniform(-1 / dim, 1 / dim, (width, dim)).astype(np.float32)
    w = rng.normal(0, 0.5, (dim, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.01
        for i in rng.permutation(used):
            at, x = sparse[i]
            hidden = x @ e[at]
            z = hidden @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = w @ p
            w -= rate * np.outer(hidden, p)
            b -= rate * 0.1 * p
            e[at] -= (rate * 40) * np.outer(x, grad)
    logits = np.zeros((width + 1, len(langs)), np.float32)
    logits[:-1] = e @ w
    z = np.array([sparse[i][1] @ logits[sparse[i][0]] + b for i in kept])
    loss = lambda t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - ((z - z.max(1, keepdims=True)) / t)[np.arange(len(kept)), y[kept]]))
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.7, 8.0), key=loss)
    return Model(langs, logits, b.astype(np.float64), temperature, holders > 0, reject_below)


def _known_share(known: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (known + SMOOTH) / (count + SMOOTH)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def predict_texts(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, or -1; calibrated probability; whether it is rejected) of each row."""
    rows, langs = len(offsets) - 1, len(model.langs)
    if not langs:
        return np.full(rows, -1), np.zeros(rows), np.ones(rows, bool)
    total, count, known = np.zeros((rows, langs)), np.zeros(rows), np.zeros(rows)
    for _, row, g in _grams(data, offsets):
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for own in g:
            total[row[cut]] += np.add.reduceat(model.logits[own >> (KNOWN_BITS - BITS)], cut, axis=0)
            count[row[cut]] += np.add.reduceat((own != _NONE).astype(np.int64), cut)
            known[row[cut]] += np.add.reduceat(model.known[own].astype(np.int64), cut)
    p = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(1)
    letters = _has_letter(data, offsets)
    return np.where(letters, best, -1), np.where(letters, p[np.arange(rows), best], 0.0), ~letters | (_known_share(known, count) < model.reject_below)


def _predicted(batch: pa.RecordBatch, m: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, index of the language, score, whether rejected) by slices of a batch, so that working memory does not follow it."""
    text = batch.schema.get_field_index("text")
    _, ends = kernel.buffers(batch.column(text))
    for lo, hi in kernel.row_slices(ends, 1 << 20):
        part = batch.slice(lo, hi - lo)
        yield part, *predict_texts(*kernel.buffers(part.column(text)), m)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected instead of columns of those names."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    docs = small_batches(docs.select(*kept))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x languages, and 2 MB of known n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part, best, score, rejected in _predicted(batch, shared.value):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], [*part.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_rejected boolean")


def query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def stage(docs: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # of fixed size, as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, rejected in _predicted(batch, shared.value):
                yield part.filter(pa.array(~rejected))

    return small_batches(docs).mapInArrow(run, docs.schema)
