from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.decontam import PASSAGE, STRIDE, Passages, Q, budget_of, contaminated, without_contaminated

ITEMS = "item_id long, text string"


def fold(text):
    out, last = [], ""
    for c in text or "":
        c = c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Þ" and c != "×" else " " if c in " \t\n\v\f\r" else c
        if c != " " or last != " ":
            out.append(c)
        last = c
    return "".join(out).encode()


def least_edits(pattern, text):
    """Of the pattern against any part of the text."""
    row = np.arange(len(pattern) + 1)
    best = row[-1]
    steps = np.arange(len(pattern) + 1)
    own = np.frombuffer(pattern, np.uint8)
    for b in text:
        moved = np.minimum(row + 1, np.concatenate([[0], row[:-1] + (own != b)]))
        moved[0] = 0
        row = np.minimum.accumulate(moved - steps) + steps
        best = min(best, row[-1])
    return int(best)


def brute(docs, items):
    out = set()
    for item, raw in items:
        own = fold(raw).strip(b" ")
        if len(own) < Q:
            out |= {(d, item) for d, text in docs if own and fold(text).strip(b" ") == own}
            continue
        starts = [0] if len(own) <= PASSAGE else [*range(0, len(own) - PASSAGE, STRIDE), len(own) - PASSAGE]
        for d, text in docs:
            for s in starts:
                part = own[s : s + PASSAGE]
                if least_edits(part, fold(text)) <= budget_of(len(part)):
                    out.add((d, item))
                    break
    return out


def edited(text, n, rng):
    own = list(text)
    for _ in range(n):
        k = rng.randrange(len(own))
        own[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [own[k], rng.choice("xyz")]])
    return "".join(own)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, frame, prose, seed):
    rng = random.Random(seed)
    items = [(k, prose(rng.choice([2, 6, 14, 40]), 700 * seed + k)) for k in range(8)]
    docs = []
    for d in range(50):
        item = rng.choice(items)[1]
        part = item[rng.randint(0, max(0, len(item) - 130)) :][: rng.choice([60, 100, 200])]
        docs.append((d, prose(rng.randint(0, 30), 9000 + d) + " " + edited(part, rng.choice([0, 1, 4, 7, 9, 14]), rng).upper() + " " + prose(rng.randint(0, 30), 5000 + d)))
    got = contaminated(frame(docs), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    for r in got:  # the span holds what was found
        text = dict(docs)[r.doc_id].encode()
        assert 0 <= r.begin < r.end <= len(text)


def test_odd_rows(spark, frame, prose):
    item = prose(40, 3)
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "abc"), (None, item), (5, "   " + prose(3, 8) + "\n")]
    long = prose(60_000, 6) + " " + item.replace(" ", "\n\t") + " " + prose(1000, 7)
    docs = [(1, None), (2, ""), (3, "abc"), (4, item), (4, item), (5, long), (6, prose(500, 11)), (7, f"x{prose(3, 8)}y"), (None, item)]
    got = sorted((r.doc_id, r.item_id) for r in contaminated(frame(docs), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(3, 4), (4, 1), (5, 1), (7, 5)]
    kept = without_contaminated(frame(docs), spark.createDataFrame(items, ITEMS))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 6, None]


def test_items_without_a_qgram_match_equal_documents(spark, frame):
    items = [(1, "Abc"), (2, " abc\n"), (3, "a\tb"), (4, "ÉÀ"), (5, "1234567"), (6, "12345678")]
    docs = [(1, "abc"), (2, "  ABC "), (3, "abcd"), (4, "a  b"), (5, "éà"), (6, "1234567"), (7, "12345678"), (8, "x 1234567"), (9, ""), (10, " ")]
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(docs), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs, items) >= {(1, 1), (2, 2), (4, 3), (5, 4), (6, 5), (7, 6)}


def test_columns_named_like_the_operators_own(spark, frame, prose):
    items = spark.createDataFrame([(k, prose(30, k), k) for k in range(9)], ITEMS + ", hit long").withColumn("doc_id", F.lit(1))
    docs = frame([(k, prose(20, 99 + k) + " " + prose(30, k)) for k in range(24)])
    for name in ("hit", "hit_", "item_id", "begin", "key", "part", "cls", "spans"):
        docs = docs.withColumn(name, F.col("doc_id") + 1)
    out = without_contaminated(docs, items)
    assert out.schema == docs.schema and sorted((r.doc_id, r.hit) for r in out.collect()) == [(k, k + 1) for k in range(9, 24)]


def test_blocks_do_not_change_the_result(spark, frame, prose):
    items = spark.createDataFrame([(k, prose(30, k)) for k in range(9)], ITEMS)
    docs = frame([(k, prose(20, 99 + k) + " " + prose(30, k % 12)) for k in range(24)])
    whole, parts = (sorted(map(tuple, contaminated(docs, items, n).collect())) for n in (1 << 20, 300))
    assert whole == parts and len(whole) == 18


def test_a_match_counts_once(spark, frame, prose):
    item = prose(12, 4)[:60]
    docs = frame([(k, prose(k, 50 + k) + " " + item + " " + prose(9, 80 + k)) for k in range(12)])
    got = contaminated(docs, spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert len(got) == 12 and {r.passages for r in got} == {1}


def test_empty_tables(spark, frame, prose):
    items = spark.createDataFrame([(1, prose(20, 1))], ITEMS)
    assert contaminated(frame([]), items).collect() == []
    assert contaminated(frame([(1, prose(20, 1))]), items.limit(0)).collect() == []


def test_a_text_of_one_letter_is_no_worst_case():
    index = Passages([(1, b"a" * 500)])
    data = np.full(20_000, 97, np.uint8)
    doc, passage, _ = index.candidates(data, np.array([0, len(data)]))
    assert len(doc) and set(passage.tolist()) <= set(range(len(index.item)))
