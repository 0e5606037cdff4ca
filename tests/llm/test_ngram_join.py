from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ngram_join
from shelfmark.llm.common import SHUFFLES_GO, staged
from shelfmark.llm.ngram_join import Bands, ngram_jaccard_join, one_of_each


def brute(rows, words, num, den):
    sets, root = [], {}
    for d, text in rows:
        if d is None:
            continue
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((d, {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} - {()}))
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sorted((d, len(s), find(d)) for d, s in sets)


def near_copies(prose, seed, groups=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng.choice([3, 7, 20, 60, 200]), 100 * seed + g).split()
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(["Alpha", "beta", "GAMMA"])
            rows.append((len(rows), (" " if rng.random() < 0.7 else "\n\t ").join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_equals_brute_force(frame, prose, words, num, den, seed):
    rows = near_copies(prose, seed)
    assert sorted(map(tuple, ngram_jaccard_join(frame(rows), words, num, den).collect())) == brute(rows, words, num, den)


def test_odd_rows(frame, prose):
    long = prose(30_000, 9)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"), (None, long), (9, "É one two three four five"), (10, "é one two three four five")]
    assert sorted(map(tuple, ngram_jaccard_join(frame(rows)).collect())) == brute(rows, 5, 80, 100)


def test_empty_table(frame):
    assert ngram_jaccard_join(frame([])).collect() == []


def test_large_group_of_copies(frame, prose):
    base = prose(80, 4)
    rows = [(k, base if k % 2 else base + f" tail{k % 7}") for k in range(1500)] + [(5000, prose(80, 5))]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(frame(rows)).collect()}
    assert got == {k: 0 for k in range(1500)} | {5000: 5000}


def test_linked_sizes_meet_in_a_band():
    bands = Bands(85, 100)
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            assert set(bands.of(a)) & set(bands.of(b)), (a, b)


def test_one_of_each_keeps_rows_and_columns(frame, prose):
    rows = [(3, prose(40, 1)), (1, prose(40, 1) + " x"), (2, prose(40, 2)), (7, None), (8, ""), (None, prose(40, 1))]
    docs = frame(rows)
    for name in ("key", "part", "cls", "root", "own", "own_", "spans", "role", "salt", "n", "held_out", "component_id"):
        docs = docs.withColumn(name, F.col("doc_id") * 2)
    out = one_of_each(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, r.cls or 0, r.own or 0) for r in out.collect()) == [(0, 0, 0), (1, 2, 2), (2, 4, 4), (7, 14, 14), (8, 16, 16)]


def test_one_of_each_of_rows_that_share_an_id(frame, prose):
    a, b, c = (prose(50, k) for k in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (3, c + " x"), (3, None), (3, ""), (4, a), (None, a), (None, a)]
    got = sorted((r.doc_id or 0, r.text or "") for r in one_of_each(frame(rows)).collect())
    assert got == sorted([(0, a), (0, a), (1, a), (1, b), (2, c), (3, "")])


def test_sets_of_one_class_by_chance(frame, prose):
    rows = near_copies(prose, 5)
    assert sorted(map(tuple, ngram_jaccard_join(frame(rows), 5, 80, 100, bits=3).collect())) == brute(rows, 5, 80, 100)


def test_many_members_of_a_split_part(frame, prose, monkeypatch):
    """A passage that fills most of many documents of one size: their parts meet, they don't."""
    monkeypatch.setattr(ngram_join, "HEAD_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "LEADERS", 6)
    common = prose(60, 1)
    rows = [(k, f"{common} {prose(16 + k % 3, 100 + k // 2)}") for k in range(60)]
    assert sorted(map(tuple, ngram_jaccard_join(frame(rows)).collect())) == brute(rows, 5, 80, 100)


def test_repeated_ids(frame, prose):
    rows = [(1, prose(50, 1)), (1, prose(50, 2)), (2, prose(50, 2)), (3, prose(50, 3))]
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard_join(frame(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_no_text_is_dealt_to_pairs_that_sketches_close(spark, prose, monkeypatch):
    """Documents that share half of their words have equal parts, but no pair of them comes to be verified."""
    asked, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *more: asked.append(pairs.count()) or real(pairs, *more))
    rows = [(k, f"{prose(60, 1)} {prose(60, 100 + k)}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()) == brute(rows, 5, 80, 100)
    assert asked and not any(asked)


def test_a_pivot_of_many_partners_is_verified_in_groups(spark, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOT_PARTNERS", 2)
    rows = near_copies(prose, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()) == brute(rows, 5, 80, 100)


def test_what_was_shuffled_for_a_staged_table_goes(spark):
    files = lambda: {str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if str(f.getName()).startswith("shuffle_")}
    before, rows = files(), spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    out = staged(rows, "counted")
    end = time.monotonic() + 10
    while files() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7 and spark.conf.get(SHUFFLES_GO) == "false"
