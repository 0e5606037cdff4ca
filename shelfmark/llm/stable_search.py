"""Approximate nearest neighbours by cosine: stable projections, a kd-tree over them, a chi-square stopping test.

Unit vectors are projected on `dims` Gaussian directions. The squared projected distance of two vectors is their squared
distance times a chi-square variable of `dims` degrees. Neighbours come in the order of their projected distance and are
verified on the vectors until the next one lies so far out that a vector as near as the running kth would come
before it with probability `confidence`.

A kd-tree fitted on a bounded sample deals all rows into ranges, each shard builds the kd-tree of its rows. A query looks
first at one shard of its own range, then at all shards whose bounding box the test still leaves open at the kth
distance found, each time with all rows of the shard behind the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import drop_staged, staged
from shelfmark.llm.vectors import Shards, finite, lists, matrix, meet, whole

#: The sample that the ranges are fitted on: about so many projected vectors, whatever the table's size.
SAMPLE = 16_384
#: Ranges at most, which bounds the boxes that each task holds.
RANGES = 1024
#: Rows of a leaf of a shard's kd-tree.
LEAF = 64
#: Squared distances of unit vectors are known up to this.
SLACK = 1e-12
_SEED = 20_140_901


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of `dims` degrees <= x) = p, for an even number of degrees."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


def directions(width: int, dims: int) -> np.ndarray:
    """The same Gaussian rows for any width: a shorter vector is one padded with zeros."""
    return np.random.default_rng(_SEED).standard_normal((width, dims))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times powers of two, which changes no digit, so that no square over- or underflows; and their norms."""
    _, e = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    vectors = np.ldexp(vectors, -e[:, None])
    return vectors, np.sqrt((vectors * vectors).sum(axis=1))


class Ranges:
    """The top of the kd-tree: halves a sample at the median of its widest direction, level by level."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, n = levels, 2**levels - 1
        self.axis, self.cut = np.zeros(n, np.int64), np.zeros(n)
        inside = np.zeros(len(sample), np.int64)
        for node in range(n):
            rows = np.flatnonzero(inside == node)
            if len(rows):
                self.axis[node] = np.argmax(np.ptp(sample[rows], axis=0))
                side = sample[rows, self.axis[node]]
                self.cut[node] = np.median(side)
                inside[rows] = 2 * node + 1 + (side > self.cut[node])

    def of(self, projected: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(projected), np.int64), np.arange(len(projected))
        for _ in range(self.levels):
            node = 2 * node + 1 + (projected[rows, self.axis[node]] > self.cut[node])
        return node - (2**self.levels - 1)


class Tree:
    """A shard's rows in the order of a kd-tree over their projections, with the box of each leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        order = np.arange(len(ids))
        spans, ends = [(0, len(ids))], []
        while spans:
            a, b = spans.pop()
            if b - a <= LEAF:
                ends.append(b)
                continue
            axis = np.argmax(np.ptp(projected[order[a:b]], axis=0))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(projected[order[a:b], axis], half)]
            spans += [(a + half, b), (a, a + half)]
        self.edges = np.array([0, *ends])
        self.ids, self.points = ids[order], projected[order]
        self.vectors, self.norms = scaled(vectors[order])
        self.units = self.vectors / self.norms[:, None]
        starts = self.edges[:-1]
        self.low, self.high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)

    def arrivals(self, point: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (rows, squared projected distances), nearest first; leaves are opened two, four, eight... at a time."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        boxes = (gap * gap).sum(axis=1)
        leaves = np.argsort(boxes, kind="stable")
        rows, away = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 2
        while done < len(leaves):
            opened = leaves[done : done + step]
            done, step = done + step, step * 2
            more = np.concatenate([np.arange(self.edges[x], self.edges[x + 1]) for x in opened])
            off = self.points[more] - point
            rows, away = np.concatenate([rows, more]), np.concatenate([away, (off * off).sum(axis=1)])
            ready = away <= boxes[leaves[done]] if done < len(leaves) else np.ones(len(rows), bool)
            now = np.flatnonzero(ready)
            now = now[np.argsort(away[now], kind="stable")]
            for a in range(0, len(now), 512):
                yield rows[now[a : a + 512]], away[now[a : a + 512]]
            rows, away = rows[~ready], away[~ready]

    def nearest(self, own: int, vector: np.ndarray, norm: float, point: np.ndarray, k: int, floor: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (ids, cosines) of at least floor, best first, without the row `own`. reach: the test's quantile."""
        ids, scores, unit = np.zeros(0, np.int64), np.zeros(0), vector / norm
        for rows, away in self.arrivals(point):
            limit = reach * (max(0.0, 2 - 2 * floor) + SLACK)
            if away[0] > limit:
                break
            rows = rows[: np.searchsorted(away, limit, "right")]
            rows = rows[self.units[rows] @ unit >= floor - 1e-9]
            rows = rows[self.ids[rows] != own]
            if len(rows):
                exact = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
                ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, exact])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, scores[-1])
        return ids, scores


def nearest(
    rows: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", dims: int = 16, confidence: float = 0.97,
    shard_rows: int = 16_384, asks_a_task: int = 4096,
) -> DataFrame:
    """For each row where asks holds, its k nearest other rows by cosine: query_id, rank (from 1), vec_id, score.

    score is the cosine in double precision on the vectors themselves; ties go to the smaller id. A row with a null id, or
    whose vector is null, empty, all zero or holds a null, NaN or infinite component takes no part. Vectors of different
    lengths compare as if padded with zeros. Rows equal in id and vector count once; rows with the query's own id are never
    its neighbours, and an id that stands with several vectors has a result for each of them. A query with fewer than k
    candidates gets all of them, an empty table none. Other columns are not looked at. dims must be even.

    Of vectors that are equal the k + 1 with the smallest ids stand for all: any further copy has k other rows of the same
    score and a smaller id before it, for any query.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    reach = chi_square_quantile(confidence, dims)
    clean = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), asks.alias("asks"))
    clean = clean.where(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)).dropDuplicates(["id", "vector"]).withColumn("key", F.xxhash64("vector"))
    copies = Window.partitionBy("key", "vector").orderBy("id")
    kept = clean.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, norms = scaled(matrix(b["vector"]))
            points = (vectors / norms[:, None]) @ directions(vectors.shape[1], dims)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "key", "vector")), lists(points)], ["id", "key", "vector", "point"])

    shape = "id long, key long, vector array<double>, point array<double>"
    candidates = staged(kept.select("id", "key", "vector").mapInArrow(projected, shape), "ann-rows")
    queries = staged(clean.where("asks").select("id", "key", "vector").mapInArrow(projected, shape), "ann-queries")

    n = candidates.count()
    levels = max(0, math.ceil(math.log2(max(1, n / shard_rows))))
    levels = min(levels, int(math.log2(RANGES)))
    share = max(1, round(2**30 * min(1.0, SAMPLE / max(1, n))))
    sample = candidates.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).select("point").toArrow()
    top = Ranges(matrix(whole(sample, "point"), width=dims), levels)
    ranges = 2**levels

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, high = np.zeros(ranges, np.int64), np.full((ranges, dims), np.inf), np.full((ranges, dims), -np.inf)
        for b in batches:
            points = matrix(b["point"], width=dims)
            at = top.of(points)
            size += np.bincount(at, minlength=ranges)
            np.minimum.at(low, at, points)
            np.maximum.at(high, at, points)
        seen = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(size[seen]), lists(low[seen]), lists(high[seen])], ["range", "n", "low", "high"])

    found = candidates.select("point").mapInArrow(boxes, "range int, n long, low array<double>, high array<double>").groupBy("range").agg(
        F.sum("n").alias("n"), F.array(*(F.min(F.col("low")[i]) for i in range(dims))).alias("low"), F.array(*(F.max(F.col("high")[i]) for i in range(dims))).alias("high"))
    size, low, high = np.zeros(ranges, np.int64), np.full((ranges, dims), np.inf), np.full((ranges, dims), -np.inf)
    for r in found.collect():  # a row for each of at most RANGES ranges
        size[r["range"]], low[r["range"]], high[r["range"]] = r["n"], r["low"], r["high"]
    shards = Shards(size, shard_rows)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            vectors, norms = scaled(matrix(whole(right, "vector")))
            points, own = matrix(whole(right, "point")), right["id"].to_numpy()
            floors = right["floor"].to_numpy()
            if left.num_rows:
                width = vectors.shape[1]
                stored = matrix(whole(left, "vector"), width=width)
                vectors = np.pad(vectors, ((0, 0), (0, stored.shape[1] - width)))
                tree = Tree(left["id"].to_numpy(), stored, matrix(whole(left, "point")))
                out = [tree.nearest(own[i], vectors[i], norms[i], points[i], k, floors[i], reach) for i in range(len(own))]
            else:
                out = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        ids, scores = pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.list_(pa.float64()))
        return right.select(["id", "key", "vector", "point"]).append_column("ids", ids).append_column("scores", scores)

    def first(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(t.num_rows), top.of(matrix(whole(t, "point"), width=dims))

    def others(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        points, floor, own = matrix(whole(t, "point"), width=dims), t["floor"].to_numpy(), t["id"].to_numpy()
        limit, away = reach * (np.maximum(0, 2 - 2 * floor) + SLACK), np.empty((len(points), ranges))
        for r in range(ranges):
            gap = np.maximum(np.maximum(low[r] - points, points - high[r]), 0)
            away[:, r] = (gap * gap).sum(axis=1) if size[r] else np.inf
        return np.nonzero(away <= limit[:, None])

    def range_of(t: pa.Table) -> np.ndarray:
        return top.of(matrix(whole(t, "point"), width=dims))

    result = f"{shape}, ids array<long>, scores array<double>"
    asked = queries.withColumn("floor", F.lit(-2.0))
    home = staged(meet(candidates, asked, ranges, shards, asks_a_task, range_of, first, True, search, result), "ann-home")
    asked = home.withColumn("floor", F.coalesce(F.try_element_at("scores", F.lit(k)), F.lit(-2.0))).drop("ids", "scores")
    away = meet(candidates, asked, ranges, shards, asks_a_task, range_of, others, False, search, result)

    pairs = F.explode(F.arrays_zip("ids", "scores")).alias("pair")
    both = home.select("id", "key", pairs).unionByName(away.select("id", "key", pairs)).select("id", "key", "pair.*")
    order = Window.partitionBy("id", "key").orderBy(F.col("scores").desc(), F.col("ids"))
    out = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = staged(out.select(F.col("id").alias("query_id"), "rank", F.col("ids").alias("vec_id"), F.col("scores").alias("score")), "ann-nearest")
    drop_staged(candidates, queries, home)
    return out
