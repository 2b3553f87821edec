"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Each document gets a small vector of surface features of its whole text. From pairs of a
good and a bad training document the model learns w by logistic loss on the difference of
their features, P(good above bad) = sigmoid(w . (f_good - f_bad)), by stochastic gradient
descent in numpy. A threshold is then chosen among the quantiles of the training scores,
and scores are mapped to 0..1 so that the threshold lies at CUT.

Training uses at most SAMPLE labelled rows of each label, chosen by a hash of the id.

Defined results: a null text counts as empty; empty texts get a score like others. Rows
with a null id are scored, and count as the empty id for the fold. Repeated rows are each
scored. Labels that are null, or ids without a document, teach nothing; with one label
only, or none, all scores are 0.5. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import kernel
from keelson.llm.common import crc_mod

#: Labelled rows of each label that training uses at most.
SAMPLE = 4000
#: A document is predicted good from this score on.
CUT = 0.3

_KINDS = ("upper", "lower", "digit", "space", "newline", "bar", "bang", "mark", "stop", "other", "symbol")
_CLASS = np.full(256, _KINDS.index("other"), np.int64)
_CLASS[65:91] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "*#$%&@^~="]] = 7
_CLASS[[ord(c) for c in ".,;:?"]] = 8
_CLASS[[ord(c) for c in "<>{}[]\\/_+"]] = 10
FEATURES = (*(f"share_{k}" for k in _KINDS), *(f"seen_{k}" for k in ("upper", "digit", "bar", "bang", "mark", "symbol")), "repeated", "seen_repeated", "log_words", "word_bytes", "few_words")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; counts are over the whole text."""
    rows = len(offsets) - 1
    count = np.zeros((rows, len(_KINDS)), np.int64)
    for lo in range(0, len(data), kernel.PIECE):
        hi = min(lo + kernel.PIECE, len(data))
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (lo, hi - 1))
        row = np.repeat(np.arange(last - first + 1), np.diff(np.clip(offsets[first : last + 2], lo, hi)))
        count[first : last + 1] += np.bincount(row * len(_KINDS) + _CLASS[data[lo:hi]], minlength=(last - first + 1) * len(_KINDS)).reshape(-1, len(_KINDS))
    size = np.maximum(count.sum(1), 1)
    share = count / size[:, None]
    h, start, end, first = kernel.words(data, offsets)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h):
        same[2:] = np.cumsum((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    repeated = (same[first[1:]] - same[first[:-1]]) / np.maximum(n, 1)
    length = np.concatenate([[0], np.cumsum(end - start)])
    mean = (length[first[1:]] - length[first[:-1]]) / np.maximum(n, 1)
    seen = [share[:, _KINDS.index(k)] > at for k, at in (("upper", 0.15), ("digit", 0.1), ("bar", 0.02), ("bang", 0.02), ("mark", 0.03), ("symbol", 0.05))]
    return np.column_stack([np.sqrt(share), *seen, repeated, repeated > 0.2, np.log1p(n), np.minimum(mean, 40) / 10, n < 5]).astype(np.float64)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, f: np.ndarray) -> np.ndarray:
        return ((f - self.centre) / self.scale) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(f) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernel.buffers(batch.column(batch.schema.get_field_index("text")))
        f = np.concatenate([features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in kernel.row_slices(offsets)] or [np.zeros((0, len(FEATURES)))])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")).cast(pa.int32()), pa.array(list(f), pa.list_(pa.float64()))], ["label", "f"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, f) of at most ``sample`` rows of each label, of the learning folds."""
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    # the smallest hashes of each label: every task keeps ``sample`` rows at most
    of = lambda label: good.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = of(0).unionByName(of(1))
    # two labels times ``sample`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(_featured, "label int, f array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 40, seed: int = 11) -> Model:
    rows = sorted((r.label, tuple(r.f)) for r in training_rows(docs, labels, sample).collect())
    f = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r[0] for r in rows], dtype=int)
    width = len(FEATURES)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(CUT / (1 - CUT))), 1.0)
    centre, scale = f.mean(0), np.maximum(f.std(0), 1e-3)
    x = (f - centre) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    w, velocity = np.zeros(width), np.zeros(width)
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs) + 0.01
        for _ in range(max(8, len(rows) // 128)):
            d = x[rng.choice(good, 64)] - x[rng.choice(bad, 64)]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            velocity = 0.8 * velocity + ((1 - p) @ d) / 64 - 1e-3 * w
            w = w + rate * velocity
    s = x @ w
    # the quantile of the training scores at which both labels are told apart best
    best = max(np.unique(np.quantile(s, np.linspace(0, 1, 201))), key=lambda t: ((s[good] >= t).mean() + (s[bad] < t).mean(), -abs(t)))
    below = s[s < best]
    threshold = float((best + below.max()) / 2) if len(below) else float(best)
    slopes = np.geomspace(0.05, 8, 24) / max(s.std(), 1e-6)

    def loss(k: float) -> float:
        z = np.clip(k * (s - threshold) + np.log(CUT / (1 - CUT)), -30, 30)
        each = np.log1p(np.exp(np.where(y == 1, -z, z)))
        return each[good].mean() + each[bad].mean()

    return Model(centre, scale, w, threshold, float(min(slopes, key=loss)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            parts = [shared.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in kernel.row_slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["doc_id", "quality_score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, quality_score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
