"""Vector best-fit packing of documents into training sequences.

A document is its token ids and an end id; only longer ones than a sequence are cut, into full pieces behind a first one
that takes the rest. Full pieces are sequences of their own. The rests go in groups of some GROUP pieces, dealt by hash,
so that a task's group stays bounded at any size; in a group, pieces in order of falling length go to the open bin whose
residual vector (tokens, documents, attention cost), less the piece's demand, has the smallest weighted norm, or the
largest weighted dot product with the demand, among bins with room in every dimension. Attention costs length squared.

Rows without a doc_id are left out. Null and empty texts are the end id alone. Rows that repeat a doc_id are packed one
by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import staged
from shelfmark.llm.tokens import ids

#: Pieces that are packed together; a group wastes about one sequence.
GROUP = 8192
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"


def _cut(path: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (TaskContext.get().partitionId() + 1) << 40
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(ids(text.as_py(), path), np.array(end_id, "<u4"))
                end = (len(tokens) - 1) % capacity + 1
                start = piece = 0
                while start < len(tokens):
                    sequence = None
                    if end - start == capacity:
                        own += 1
                        sequence = -own
                    rows.append((doc, piece, start, end - start, zlib.crc32(tokens[start:end].tobytes()), sequence))
                    start, end, piece = end, end + capacity, piece + 1
                if len(rows) > 50_000:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def best_fit(lengths: np.ndarray, limits: tuple[int, int, int], weights: tuple[float, float, float], select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. limits: tokens, documents and attention cost of a bin; select: norm or dot."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    scale = [w / limit for w, limit in zip(weights, limits, strict=True)]
    room = [np.full(n, limit, np.float64) for limit in limits]
    opened = 0
    live = np.zeros(0, np.int64)  # bins that can still take the shortest piece
    least = int(lengths.min()) if n else 0
    for i in np.argsort(-lengths, kind="stable"):
        need = (float(lengths[i]), 1.0, float(lengths[i]) ** 2)
        tokens, docs, cost = (r[live] for r in room)
        fits = np.flatnonzero((tokens >= need[0]) & (docs >= need[1]) & (cost >= need[2]))
        if len(fits):
            left = [(r[fits], x) for r, x in zip((tokens, docs, cost), need, strict=True)]
            if select == "dot":
                b = int(live[fits[np.argmax(sum(r * x * s * s for (r, x), s in zip(left, scale, strict=True)))]])
            else:
                b = int(live[fits[np.argmin(sum(((r - x) * s) ** 2 for (r, x), s in zip(left, scale, strict=True)))]])
        elif any(x > limit for x, limit in zip(need, limits, strict=True)):
            raise ValueError(f"a piece of {lengths[i]} tokens exceeds a sequence's limits {limits}")
        else:
            b, opened = opened, opened + 1
            live = np.append(live, b)
        bins[i], offsets[i] = b, limits[0] - int(room[0][b])
        for r, x in zip(room, need, strict=True):
            r[b] -= x
        if room[0][b] < least or room[1][b] < 1 or room[2][b] < least**2:
            live = live[live != b]
    return bins, offsets


def _pack(limits: tuple[int, int, int], weights: tuple[float, float, float], select: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(group["length"].to_numpy(), limits, weights, select)
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, max_docs: int | None = None, max_attention: int | None = None, end_id: int = 2, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), select: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    path: a byte-level BPE file that every worker can open. Without max_docs and max_attention only tokens can bind (a
    sequence of n tokens holds at most n documents and their squares add up to at most n squared), which gives the fewest
    sequences. A lower max_attention must leave room for a full piece. Further columns of docs are not read.
    """
    limits = (capacity, max_docs or capacity, max_attention or capacity**2)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    cut = staged(docs.mapInArrow(_cut(path, end_id, capacity), _PIECES), "pieces")
    rest = cut.where("sequence_id IS NULL")
    groups = max(1, -(-rest.count() // GROUP))
    rest = rest.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)))
    packed = rest.groupBy("deal").applyInArrow(_pack(limits, weights, select), _PIECES + ", offset long")
    return cut.where("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long")).unionByName(packed)
