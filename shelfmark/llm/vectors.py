"""Shards of vectors that blocks of queries meet: shared by the searches over embeddings.

A model fitted on a bounded sample deals rows into at most a fixed number of ranges. A range with more rows than one
task takes is split by a hash of the ids into shards, and a shard that many queries ask is copied for parts of them.
So no task holds more than some `rows` vectors and `asks` queries, however the rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix


def finite(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def whole(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column: pa.Array, kind: type = np.float64, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of one array, padded with zeros up to the longest, or to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    width = max(width, int(lengths.max(initial=0)))
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of an array as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


class Shards:
    """Which shards each range has, and which one holds an id. counts: rows by range."""

    def __init__(self, counts: np.ndarray, rows: int):
        self.subs = np.maximum(1, -(-counts // rows)).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.subs)])

    def of(self, ranges: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.base[ranges] + (mix(ids.astype(np.uint64)) % self.subs[ranges].astype(np.uint64)).astype(np.int64)


def by_range(df: DataFrame, ranges: int) -> np.ndarray:
    """Sums of column n by column range, as an array; `ranges` bounds what comes to the driver."""
    out = np.zeros(ranges, np.int64)
    for r in df.groupBy("range").agg(F.sum("n").alias("n")).collect():
        out[r["range"]] = r["n"]
    return out


def meet(
    candidates: DataFrame, queries: DataFrame, ranges: int, shards: Shards, asks: int, range_of: Callable[[pa.Table], np.ndarray],
    visits: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], home: bool, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    seeded: bool = True,
) -> DataFrame:
    """search(candidates, queries) for each shard and each part of the queries that visit it.

    visits gives pairs of (row of the query, range); home: a query visits only the shard that its own id would stand in;
    seeded: it has been there, and visits all but that one.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ranges, np.int64)
        for b in batches:
            n += np.bincount(visits(pa.Table.from_batches([b]))[1], minlength=ranges)
        seen = np.flatnonzero(n)
        yield pa.record_batch({"range": seen.astype(np.int32), "n": n[seen]})

    load = by_range(queries.mapInArrow(counted, "range int, n long"), ranges)
    parts = -(-load // asks)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            r, ids = range_of(t), t["id"].to_numpy()
            copies = parts[r]
            rows = np.repeat(np.arange(len(r)), copies)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
            out = t.take(pa.array(rows)).append_column("shard", pa.array(shards.of(r, ids)[rows])).append_column("part", pa.array(part))
            yield from out.to_batches()

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            rows, r = visits(t)
            ids = t["id"].to_numpy()[rows]
            part = (mix(ids.astype(np.uint64) ^ np.uint64(0x5BD1E995)) % np.maximum(1, parts[r]).astype(np.uint64)).astype(np.int64)
            if home:
                shard = shards.of(r, ids)
            else:
                subs = shards.subs[r]
                shard = np.repeat(shards.base[r], subs) + np.arange(subs.sum()) - np.repeat(np.cumsum(subs) - subs, subs)
                rows, part = np.repeat(rows, subs), np.repeat(part, subs)
                new = shard != shards.of(range_of(t), t["id"].to_numpy())[rows] if seeded else np.ones(len(shard), bool)
                rows, part, shard = rows[new], part[new], shard[new]
            out = t.take(pa.array(rows)).append_column("shard", pa.array(shard)).append_column("part", pa.array(part))
            yield from out.to_batches(max_chunksize=4096)

    key = "shard long, part long"
    left = candidates.mapInArrow(dealt, f"{_ddl(candidates)}, {key}").groupBy("shard", "part")
    right = queries.mapInArrow(asking, f"{_ddl(queries)}, {key}").groupBy("shard", "part")
    return left.cogroup(right).applyInArrow(search, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
