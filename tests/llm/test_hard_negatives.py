from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.hard_negatives import Buckets, hard_negatives, levels
from shelfmark.llm.vectors import finite

SCHEMA = "vec_id long, label int, vector array<long>"


def brute(rows, anchors, low=30, high=90, positives=5, negatives=10):
    use = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v})
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, lab, v in use:
        if anchors(i):
            first = sorted((-score(v, w), j) for j, m, w in use if m == lab and j != i)[:positives]
            for ps, p in first:
                fit = sorted((-score(v, w), j) for j, m, w in use if m != lab and low * -ps <= 100 * score(v, w) <= high * -ps)[:negatives]
                out |= {(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fit)}
    return out


def got(df):
    return {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()}


@pytest.mark.parametrize("shard_rows, asks", [(10_000, 10_000), (30, 4)])
def test_like_brute_force(spark, shard_rows, asks):
    rng = random.Random(7)
    rows = [(i, rng.randrange(4), [rng.randint(-9, 9) * rng.choice((1, 1, 5)) for _ in range(6)]) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(hard_negatives(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, asks_a_task=asks)) == brute(rows, lambda i: i % 10 == 0)


def test_copies_ties_nulls_and_clashing_columns(spark):
    rows = [(i, i % 2, [3, 1]) for i in range(120)] + [(200 + i, i % 3, [2, 0]) for i in range(60)] + [(7, 1, [3, 1]), (300, None, [1, 1]), (301, 1, None), (302, 1, [1, None]), (None, 1, [1, 1]), (303, 0, []), (304, 1, [1, 1, 1]), (305, 0, [-3, -3])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", squares int, key string").repartition(4)
    assert got(hard_negatives(df, F.col("vec_id") % 5 == 0, shard_rows=20)) == brute(rows, lambda i: i % 5 == 0)


def test_empty_table_and_lone_label(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(spark.createDataFrame([(0, 1, [1]), (1, 1, [1])], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_sums_beyond_double_precision(spark):
    big = 2**30 - 1
    rows = [(0, 0, [big, big, 3]), (1, 0, [big, big, 5]), (2, 1, [big - 2**27, big - 2**27, 1]), (3, 1, [big - 2**27, big - 2**27, 2])]
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)


def test_levels_and_finite(spark):
    rows = [(1, [0.5, -0.001, 1.0]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, [None])]
    out = spark.createDataFrame(rows, "id int, v array<float>").where(finite(F.col("v"))).select("id", levels(F.col("v")).alias("v")).collect()
    assert [(r.id, r.v) for r in out] == [(1, [128, -1, 256])]


def test_buckets_close_by_the_bound():
    import pyarrow as pa

    n = 5000
    t = pa.table({"id": np.arange(n), "squares": np.arange(n) ** 2, "label": np.zeros(n, np.int64), "vector": pa.array([[i] for i in range(n)])})
    seen = []

    def takes(store, rows, i):
        seen.append(rows.start)
        return np.ones(len(store.ids[rows]), bool)

    found = Buckets(t, 1).best(np.array([[2]]), np.array([4]), takes, [[(0, 2**62, 3)]])
    assert found[0][0][0].tolist() == [4999, 4998, 4997] and seen == [0]
