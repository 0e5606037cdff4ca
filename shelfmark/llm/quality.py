"""Quality by pairwise ranking.

Documents are described by shares of byte classes, repeated words and repeated lines over the whole text. Preference
pairs, a document of label 1 over one of label 0, are drawn from a bounded sample of labelled rows, and the
Bradley-Terry model learns a score by logistic loss on the pairs' feature differences. The threshold is the score
quantile that separates the sample's other part best; scores are scaled so that it lies at 0.7.

Null, empty and blank texts have the features of no words and get a score like any other. Without labels of both kinds
every score is the share of label 1 (0.5 without labels). Null ids and labels are not learnt from. Rows may repeat: each
gets its score. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import blocks
from shelfmark.llm.labelled import logistic, remainder, sample
from shelfmark.llm.shingles import word_hashes

#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
#: Partners of each document of label 0.
PARTNERS = 8
THRESHOLD = 0.7
_MARKS = ["!", "|", "$#%&*@^~=+<>{}[]\\_`", ".,;:?'\"()-/"]
FEATURES = 16

_CLASS = np.full(256, 8, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
for _k, _marks in enumerate(_MARKS, 4):
    _CLASS[[ord(c) for c in _marks]] = _k
_CLASS[128:] = 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each document."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(docs), size)
    counts = np.bincount(doc * 10 + _CLASS[data], minlength=10 * docs).reshape(docs, 10) if len(data) else np.zeros((docs, 10))
    share = counts / np.maximum(size, 1)[:, None]
    hashes, owner = word_hashes(data, offsets)
    words = np.bincount(owner, minlength=docs) if len(owner) else np.zeros(docs, np.int64)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    same = np.bincount(owner[again], minlength=docs) if again.any() else np.zeros(docs)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=docs) if len(owner) else np.zeros(docs)
    lines, repeated = np.zeros(docs), np.zeros(docs)
    raw = data.tobytes()
    for d in range(docs):
        own = raw[offsets[d] : offsets[d + 1]].split(b"\n")
        lines[d], repeated[d] = len(own), 1 - len(set(own)) / len(own)
    n = np.maximum(words, 1)
    variety = distinct / n
    long = np.log1p(words)
    expected = variety * np.maximum(long, 1)
    return np.column_stack([share[:, [0, 1, 3, 4, 5, 6, 7, 8, 9]], variety, expected, same / n, repeated, long, np.minimum(size / n, 40), lines / n])


class Ranker:
    """score = sigmoid(slope * (weights . standardised features - cut) + logit of the threshold)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float, constant: float | None = None):
        self.mean, self.scale, self.weights, self.cut, self.slope, self.constant = mean, scale, weights, cut, slope, constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Ranker:
    """Rows of part 0 give the pairs, those of part 1 the quantile."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    flat = Ranker(mean, scale, np.zeros(FEATURES), 0, 1, float(y.mean()) if len(y) else 0.5)
    if part.min(initial=1) == part.max(initial=0):
        part = np.arange(len(y)) % 3 == 2
    good, bad = (np.flatnonzero((y == k) & (part == 0)) for k in (1, 0))
    if not len(good) or not len(bad) or len(np.unique(y)) < 2:
        return flat
    rng = np.random.default_rng(0)
    standard = np.clip((x - mean) / scale, -6, 6)
    over = good[rng.integers(0, len(good), (len(bad), PARTNERS))]
    difference = (standard[over] - standard[bad][:, None]).reshape(-1, x.shape[1])
    sign = np.where(np.arange(len(difference)) % 2, 1.0, -1.0)
    weights = logistic(difference * sign[:, None], (sign > 0).astype(float), 5.0)
    model = Ranker(mean, scale, weights, 0, 1)
    check = part == 1
    if len(np.unique(y[check])) < 2:
        check = np.ones(len(y), bool)
    raw, label = model.raw(x[check]), y[check]
    order = np.argsort(raw, kind="stable")
    ones = np.cumsum(label[order])
    zeros = np.arange(1, len(order) + 1) - ones
    # Right on both sides of a cut behind each quantile: the zeros below it and the ones above.
    right = zeros + (ones[-1] - ones)
    best = int(np.argmax(right))
    model.cut = float(raw[order[best]] + raw[order[min(best + 1, len(order) - 1)]]) / 2
    model.slope = max(0.05, float(logistic(np.column_stack([raw - model.cut, np.ones(len(raw))]), label.astype(float))[0]))
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in blocks(batch.column(0)):
            x = features(data, offsets)
            yield pa.record_batch([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "part", "x"])


def _scored(model: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(2)):
                yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array(model.score(features(data, offsets)))], names=["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, modulo: int = 4, held: int = 2) -> Ranker:
    rows = sample(docs, labels, "quality", modulo, held, limit).select("text", "label", "part").mapInArrow(_described, "label int, part int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    order = np.lexsort((*x.T, rows["part"], rows["label"]))  # the same model from any order of rows
    return fit(x[order], rows["label"].to_numpy(int)[order], rows["part"].to_numpy(int)[order])


def score(docs: DataFrame, model: Ranker, modulo: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", modulo) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
