from __future__ import annotations

import math

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from shelfmark.llm.queries import QUERIES
from shelfmark.llm.stable_search import chi_square_quantile, nearest

NAN, INF = float("nan"), float("inf")


def brute(rows, asks, k):
    """{query: [(id, cosine)]} over (id, vector) rows, in plain Python."""
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, a in use:
        if asks(q):
            scores = [(-sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)), i) for i, b in use if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def same(got, want):
    return {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x} and all(abs(a - b) < 1e-9 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)

    return make


def test_quantile():
    assert abs(chi_square_quantile(0.95, 2) - 5.991465) < 1e-5
    assert abs(chi_square_quantile(0.95, 16) - 26.296228) < 1e-5


@pytest.mark.parametrize("shard_rows, asks", [(10_000, 10_000), (40, 5)])
def test_recall_with_many_shards_and_parts(vectors, shard_rows, asks):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((900, 24)))]
    want, got = brute(rows, lambda i: i % 9 == 0, 5), found(nearest(vectors(rows), F.col("vec_id") % 9 == 0, shard_rows=shard_rows, asks_a_task=asks))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    cosines = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    assert all(abs(s - cosines[q] @ cosines[i]) < 1e-12 for q, x in got.items() for i, s in x)


def test_nearly_sure_test_is_exact(vectors):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 8)))]
    assert same(found(nearest(vectors(rows), F.col("vec_id") % 5 == 0, confidence=1 - 1e-12, shard_rows=50)), brute(rows, lambda i: i % 5 == 0, 5))


def test_large_groups_of_copies_give_the_smallest_ids(vectors):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [2.0, 4.0, 6.0]) for i in range(200, 230)] + [(300 + i, [float(i), 1.0, 0.0]) for i in range(20)]
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert want[190] == [(i, 1.0) for i in range(5)]
    assert same(found(nearest(vectors(rows), F.col("vec_id") % 10 == 0, shard_rows=16)), want)


def test_rows_that_take_no_part(vectors):
    odd = [None, [], [0.0, 0.0], [1.0, None], [NAN, 1.0], [INF, 1.0], [-INF, 1.0]]
    rows = [(10 * i, v) for i, v in enumerate(odd)] + [(None, [1.0, 1.0]), (100, [1.0, 1.0]), (101, [1.0, 0.0]), (102, [3.0]), (103, [1e300, 1e300]), (104, [1e-300, 0.0]), (101, [1.0, 0.0])]
    got = found(nearest(vectors(rows), F.col("vec_id") % 10 == 0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {100: [103, 101, 102, 104]}
    assert got[100][0][1] == pytest.approx(1)


def test_an_id_with_two_vectors_and_other_columns(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1, 2), (0, [0.0, 1.0], 1, 2), (1, [1.0, 1.0], 1, 2)], "vec_id long, embedding array<float>, key int, point int")
    got = nearest(rows, F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [(0, 1, 1, 0.707107)] * 2


def test_empty_table_and_lone_row(vectors):
    assert nearest(vectors([]), F.col("vec_id") == 0).count() == 0
    assert nearest(vectors([(0, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 50 == 0, 5), found(QUERIES["op11_nearest_neighbours"](spark, SMALL))
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
