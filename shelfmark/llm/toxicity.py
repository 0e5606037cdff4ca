"""Toxicity by compression distance.

A window is a word, lower-cased, tiled to at least TILE bytes so that a match can pay off; a word of over LONGEST bytes
gives a window for each LONGEST of them. Two zstandard dictionaries
are made from a bounded sample of labelled documents: the toxic one holds the windows that are RATIO times as frequent
in toxic documents as in ordinary ones, the ordinary one the windows most ordinary documents share, each in order of
rising frequency, as the format favours a dictionary's end. (Dictionaries of the library's own trainer over windows of
several words were measured, and do not tell the classes apart: README has the figures.) A window is a
hit if the toxic dictionary shortens it by at least GAIN bytes more than the ordinary one. How many hits, different
hits and saved bytes make a document toxic is calibrated by a logistic fit on the sample's other part; every window of
a whole text counts.

Null, empty and blank texts have no windows and get the score of no hits. Without labels of both kinds every score is
the share of label 1 (0 without labels). Null ids and labels are not learnt from. Rows may repeat: each gets its score.
Further columns are not read, or carried along by without_toxic. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import binary
from shelfmark.llm.labelled import logistic, remainder, sample

#: Labelled rows that are learnt from, at most.
SAMPLE = 30_000
#: Bytes of the ordinary dictionary, at most.
ORDINARY_BYTES = 256 << 10
TILE, GAIN, LEVEL = 24, 3, 19
#: A toxic window's least frequency among toxic documents, and over that among ordinary ones.
SHARE, RATIO = 0.008, 8.0
LONGEST = 64
THRESHOLD = 0.5
#: Windows whose gain a worker remembers.
REMEMBERED = 300_000
FEATURES = 6

_TABLE = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    own = text.translate(_TABLE).split()
    if max(map(len, own), default=0) <= LONGEST:
        return own
    return [w[k : k + LONGEST] for w in own for k in range(0, len(w), LONGEST)]


def tile(word: bytes) -> bytes:
    word = b" " + word + b" "
    return word * (1 + TILE // len(word))


class Distance(dict):
    """Of each window how many bytes the toxic dictionary saves over the ordinary one; 0 if fewer than GAIN."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.sides = toxic, ordinary
        own = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.shorter, self.other = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **own).compress for x in self.sides)

    def __reduce__(self):
        return Distance, self.sides

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        window = tile(word)
        gain = len(self.other(window)) - len(self.shorter(window))
        self[word] = gain = gain if gain >= GAIN else 0
        return gain

    def features(self, text: bytes) -> list[float]:
        own = words(text)
        gains = [(w, g) for w, g in zip(own, map(self.__getitem__, own)) if g]
        hits, kinds, saved = len(gains), len({w for w, _ in gains}), sum(g for _, g in gains)
        long = np.log(10 + len(own))
        return [1.0, np.log1p(hits), np.log1p(kinds), np.log1p(saved), np.log1p(hits) / long, long]


class Classifier:
    def __init__(self, distance: Distance | None, weights: np.ndarray | None, constant: float = 0.0):
        self.distance, self.weights, self.constant = distance, weights, constant

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(texts), self.constant)
        x = np.array([self.distance.features(t) for t in texts], float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            own = sorted(set(words(text.as_py())))
            yield pa.record_batch([pa.array(own, pa.binary()), pa.array([label] * len(own), pa.int32())], names=["word", "label"])


def _measured(distance: Distance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [distance.features(t.as_py()) for t in binary(batch.column(0))]
            yield pa.record_batch([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, modulo: int = 5, held: int = 0) -> Classifier:
    rows = sample(docs, labels, "toxic", modulo, held, limit).persist()
    try:
        sizes = {(r.label, r.part): r["count"] for r in rows.groupBy("label", "part").count().collect()}
        toxic, ordinary = (sizes.get((k, 0), 0) for k in (1, 0))
        total = sum(sizes.values())
        constant = sum(n for (k, _), n in sizes.items() if k) / total if total else 0.0
        if not toxic or not ordinary:
            return Classifier(None, None, constant)
        seen = rows.where("part = 0").select("text", "label").mapInArrow(_vocabulary, "word binary, label int")
        seen = seen.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o"))
        # Each word is in SHARE of the toxic documents at least, so there are at most 1 / SHARE times as many as a toxic
        # document has on average; the others are bounded by their dictionary's size.
        chosen = seen.where(F.col("t") >= max(3, SHARE * toxic)).where(F.col("t") * ordinary >= RATIO * (F.col("o") + 1) * toxic)
        bad = chosen.orderBy(F.desc("t"), "word").collect()
        names = {bytes(r.word) for r in bad}
        usual = [r for r in seen.where("o >= 2").orderBy(F.desc("o"), "word").limit(ORDINARY_BYTES // TILE + len(names)).collect() if bytes(r.word) not in names]
        content = [b"".join(tile(bytes(r.word)) for r in reversed(x))[-size:] for x, size in ((bad, 0), (usual, ORDINARY_BYTES))]
        if not all(len(x) >= 8 for x in content):
            return Classifier(None, None, constant)
        distance = Distance(*content)
        part = 1 if sizes.get((1, 1)) and sizes.get((0, 1)) else 0
        found = rows.where(F.col("part") == part).select("text", "label").mapInArrow(_measured(distance), "label int, x array<double>").toPandas()
    finally:
        rows.unpersist()
    x, y = np.array(found["x"].tolist(), float).reshape(-1, FEATURES), found["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return Classifier(distance, logistic(x[order], y[order], 1.0))


def _scored(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([t.as_py() for t in binary(batch.column(2))])
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Classifier, modulo: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", modulo) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _judged(model: Classifier, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([t.as_py() for t in binary(batch.column(at))])
            yield batch.filter(pa.array(scores < THRESHOLD))

    return run


def without_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs, as they are, that are not predicted toxic."""
    return docs.mapInArrow(_judged(model, docs.columns.index("text")), docs.schema)
