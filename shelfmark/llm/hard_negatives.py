"""Hard negatives by inner product: candidates sorted by norm, in buckets that the Cauchy-Schwarz bound closes.

An inner product is at most the anchor's norm times the candidate's. Candidates are dealt into ranges of norm and sorted by
norm within a shard, longest first. Once the anchor's norm times the longest norm of a bucket is below what every window
still wants, that bucket and all behind it are closed. A window wants scores from its lower limit on, and from its
running kth score on when it is full; ranges of norm that lie below are not visited at all.

Vectors are integers, so that scores, limits and ties are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import drop_staged, staged
from shelfmark.llm.vectors import Shards, by_range, matrix, meet, whole

#: The sample that the ranges of norm are fitted on: about so many rows of two integers, whatever the table's size.
SAMPLE = 16_384
#: Ranges of norm at most.
RANGES = 1024
#: Rows of a bucket.
BUCKET = 1024
_NONE = -(2**63)


def levels(vector: Column, step: int = 256) -> Column:
    """Each component x as the integer floor(step * x), x in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(step))).cast("long"))


def products(vectors: np.ndarray, others: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of all pairs of rows; in double precision where no sum can leave its 53 bits."""
    if exact_in_double:
        return (vectors.astype(np.float64) @ others.astype(np.float64).T).astype(np.int64)
    return vectors @ others.T


class Buckets:
    """A shard's rows by norm, longest first."""

    def __init__(self, t: pa.Table, width: int):
        squares, ids = t["squares"].to_numpy(), t["id"].to_numpy()
        order = np.lexsort((ids, -squares))
        self.ids, self.squares, self.labels = ids[order], squares[order], t["label"].to_numpy()[order]
        self.vectors = matrix(whole(t, "vector"), np.int64, width)[order]

    def best(self, anchors: np.ndarray, squares: np.ndarray, takes, windows: list[list[tuple[int, int, int]]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and each of its windows (lower limit, upper limit, k): up to k (ids, scores), best first.

        takes(rows, anchor): which rows of a slice are candidates for the anchor.
        """
        found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in w] for w in windows]
        wants = [[low for low, _, _ in w] for w in windows]
        open_ = np.array([i for i, w in enumerate(windows) if any(low <= high for low, high, _ in w)], np.int64)
        small = len(self.squares) > 0 and math.sqrt(float(self.squares[0])) * math.sqrt(float(squares.max(initial=0))) < 2**52
        for a in range(0, len(self.ids), BUCKET):
            longest = float(self.squares[a])
            least = np.array([min((want for want, (low, high, _) in zip(wants[i], windows[i]) if low <= high)) for i in open_], np.float64)
            open_ = open_[np.sqrt(squares[open_].astype(np.float64) * longest) * (1 + 1e-9) + 1 >= least] if len(open_) else open_
            if not len(open_):
                break
            rows = slice(a, a + BUCKET)
            scores = products(anchors[open_], self.vectors[rows], small)
            for i, s in zip(open_, scores):
                at = np.flatnonzero(takes(self, rows, i) & (s >= min(wants[i])))
                ids, s = self.ids[rows][at], s[at]
                for j, (low, high, k) in enumerate(windows[i]):
                    fit = (s >= wants[i][j]) & (s <= high)
                    if low <= high and fit.any():
                        both = np.concatenate([found[i][j][0], ids[fit]]), np.concatenate([found[i][j][1], s[fit]])
                        order = np.lexsort((both[0], -both[1]))[:k]
                        found[i][j] = both[0][order], both[1][order]
                        if len(order) == k:
                            wants[i][j] = max(wants[i][j], int(found[i][j][1][-1]))
        return found


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id: str = "vec_id", label: str = "label", vector: str = "vector",
    shard_rows: int = 16_384, asks_a_task: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vector holds integers (`levels` makes them). An anchor is a row where `anchors` holds; its positives are the first
    `positives` other rows of its label by score, ties by smaller id; for each, the first `negatives` rows of other labels
    with low * positive score <= 100 * score <= high * positive score, by score, ties by smaller id.

    A row with a null id, label, vector or component takes no part. Vectors of different lengths compare as if padded with
    zeros, so an empty one scores 0. Rows equal in id, label and vector count once; rows with the anchor's own id are never
    its positives, and an id that stands with several labels or vectors is an anchor for each. With fewer positives or
    negatives all there are come; an empty table gives none. A squared norm over 63 bits is an error. Other columns are not
    looked at.

    Of rows equal in label and vector those with the smallest ids stand for all, as many as a window can return and one more.
    """
    clean = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("vector"), anchors.alias("asks"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    clean = clean.withColumn("squares", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)).dropDuplicates(["id", "label", "vector"])
    clean = clean.withColumn("key", F.xxhash64("label", "vector"))
    copies = Window.partitionBy("key", "label", "vector").orderBy("id")
    kept = clean.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives, negatives) + 1)
    columns = ["id", "key", "label", "squares", "vector"]
    shape = "id long, key long, label long, squares long, vector array<long>"
    candidates, queries = staged(kept.select(columns), "negatives-rows"), staged(clean.where("asks").select(columns), "negatives-anchors")

    n = candidates.count()
    share = max(1, round(2**30 * min(1.0, SAMPLE / max(1, n))))
    sample = candidates.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).select("squares").toArrow()["squares"].to_numpy()
    ranges = min(RANGES, max(1, -(-n // shard_rows)))
    cuts = np.unique(np.sort(sample)[(np.arange(1, ranges) * len(sample)) // ranges]) if len(sample) else np.zeros(0, np.int64)
    ranges = len(cuts) + 1

    def range_of(t: pa.Table) -> np.ndarray:
        """The range with the longest rows is 0."""
        return len(cuts) - np.searchsorted(cuts, t["squares"].to_numpy(), "right")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(ranges, np.int64)
        for b in batches:
            size += np.bincount(range_of(b), minlength=ranges)
        yield pa.record_batch({"range": np.arange(ranges, dtype=np.int32), "n": size})

    shards = Shards(by_range(candidates.select("squares").mapInArrow(sizes, "range int, n long"), ranges), shard_rows)
    longest = float(candidates.agg(F.max("squares")).first()[0] or 0)
    #: The longest squared norm that each range can hold.
    tops = np.array([longest, *cuts[::-1].astype(np.float64)])

    def reached(squares: np.ndarray, wants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.sqrt(squares.astype(np.float64)[:, None] * tops) * (1 + 1e-9) + 1 >= wants.astype(np.float64)[:, None])

    def pairs(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return t["ids"].to_pylist(), t["scores"].to_pylist()

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))]] * right.num_rows
        if left.num_rows and right.num_rows:
            own, labels, vectors, store = *_anchors(right), _store(left, right)
            windows = [[(int(f), 2**63 - 1, positives)] for f in right["floor"].to_numpy()]
            out = store.best(_wide(vectors, store), right["squares"].to_numpy(), lambda b, r, i: (b.labels[r] == labels[i]) & (b.ids[r] != own[i]), windows)
        ids, scores = pa.array([x[0][0] for x in out], pa.list_(pa.int64())), pa.array([x[0][1] for x in out], pa.list_(pa.int64()))
        return right.select(columns).append_column("ids", ids).append_column("scores", scores)

    def other_labels(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            own, labels, vectors, store = *_anchors(right), _store(left, right)
            ids, scores = pairs(right)
            windows = [[(*_limits(p, low, high), negatives) for p in s] for s in scores]
            found = store.best(_wide(vectors, store), right["squares"].to_numpy(), lambda b, r, i: b.labels[r] != labels[i], windows)
            keys = right["key"].to_numpy()
            for i, w in enumerate(found):
                for p, ps, (n_ids, n_scores) in zip(ids[i], scores[i], w):
                    out += [(own[i], keys[i], p, ps, x, y) for x, y in zip(n_ids.tolist(), n_scores.tolist())]
        names = ["anchor_id", "key", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names)

    result = f"{shape}, ids array<long>, scores array<long>"
    own_range = lambda t: (np.arange(t.num_rows), range_of(t))
    asked = queries.withColumn("floor", F.lit(_NONE))
    home = staged(meet(candidates, asked, ranges, shards, asks_a_task, range_of, own_range, True, same_label, result), "negatives-home")
    asked = home.withColumn("floor", F.coalesce(F.try_element_at("scores", F.lit(positives)), F.lit(_NONE))).drop("ids", "scores")
    away = meet(candidates, asked, ranges, shards, asks_a_task, range_of, lambda t: reached(t["squares"].to_numpy(), t["floor"].to_numpy()), False, same_label, result)

    pair = F.explode(F.arrays_zip("ids", "scores")).alias("pair")
    both = home.select("id", "key", pair).unionByName(away.select("id", "key", pair)).select("id", "key", "pair.*")
    order = Window.partitionBy("id", "key").orderBy(F.col("scores").desc(), F.col("ids"))
    firsts = both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    # At most `positives` rows an anchor.
    firsts = firsts.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "scores"))).alias("p"))
    asked = staged(queries.join(firsts, ["id", "key"]).select(columns + [F.col("p.ids").alias("ids"), F.col("p.scores").alias("scores")]), "negatives-positives")

    def visits(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # Limits rise with the positive score, and a negative one leaves nothing to find; the lowest open window decides.
        least = np.array([min((_limits(p, low, high)[0] for p in s if _limits(p, low, high)[0] <= _limits(p, low, high)[1]), default=2**62) for s in pairs(t)[1]], np.int64)
        return reached(t["squares"].to_numpy(), least)

    shape = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = meet(candidates, asked, ranges, shards, asks_a_task, range_of, visits, False, other_labels, shape, seeded=False)
    order = Window.partitionBy("anchor_id", "key", "positive_id").orderBy(F.col("negative_score").desc(), F.col("negative_id"))
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-found")
    drop_staged(candidates, queries, home, asked)
    return out


def _limits(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score of the window: low * positive <= 100 * score <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _anchors(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return right["id"].to_numpy(), right["label"].to_numpy(), matrix(whole(right, "vector"), np.int64)


def _store(left: pa.Table, right: pa.Table) -> Buckets:
    return Buckets(left, matrix(whole(right, "vector"), np.int64).shape[1])


def _wide(vectors: np.ndarray, store: Buckets) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, store.vectors.shape[1] - vectors.shape[1])))
