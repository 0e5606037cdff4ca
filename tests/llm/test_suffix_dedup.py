from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.suffix_dedup import deduplicated, permuted_common_prefixes, repeats, suffix_array, without_repeats


def covered(rows, length):
    """For each (doc_id, text), in order of doc_id, which bytes a string that starts earlier covers."""
    seen, out = set(), []
    for d, text in sorted(((d, (t or "").encode()) for d, t in rows if d is not None), key=lambda r: r[0]):
        gone = [False] * len(text)
        for k in range(len(text) - length + 1):
            own = text[k : k + length]
            if own in seen:
                gone[k : k + length] = [True] * length
            seen.add(own)
        out.append((d, text, gone))
    return out


def brute(rows, length):
    out = []
    for d, text, gone in covered(rows, length):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(prose, seed):
    rng = random.Random(seed)
    shared = [prose(rng.randint(15, 60), 50 + k) for k in range(4)]
    rows = []
    for d in range(40):
        parts = [prose(rng.randint(0, 40), 1000 * seed + 10 * d)]
        for _ in range(rng.choice([0, 1, 1, 2])):
            parts += [rng.choice(shared)[rng.randint(0, 30) :], prose(rng.randint(0, 9), rng.random())]
        rows.append((d * 3 + 1, " ".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(frame, prose, seed):
    rows = passages(prose, seed)
    assert sorted(map(tuple, deduplicated(frame(rows)).collect())) == brute(rows, 100)


@pytest.mark.parametrize("heavy", [1, 700, 3000])
def test_heavy_keys_are_cut_without_loss(frame, prose, heavy):
    rng = random.Random(heavy)
    line = prose(12, 77)
    rows = [(d, f"{prose(rng.randint(0, 6), rng.randint(0, 5))} {line} {prose(rng.randint(0, 9), rng.randint(0, 9))}") for d in range(120)]
    rows += [(200 + d, "z" * (150 + 9 * d) + "ab" * (60 + d) + line * rng.randint(1, 3)) for d in range(20)]
    assert sorted(map(tuple, deduplicated(frame(rows), 100, heavy).collect())) == brute(rows, 100)


@pytest.mark.parametrize("heavy", [400, 20_000])
def test_a_gram_in_every_document(frame, prose, heavy):
    line = prose(4, 5)[:30]
    rows = [(d, f"{prose(20, d % 90)} {line} {prose(20, d % 70)}") for d in range(300)]
    assert sorted(map(tuple, deduplicated(frame(rows), 100, heavy).collect())) == brute(rows, 100)


def test_columns_named_like_the_operators_own(frame, prose):
    rows = passages(prose, 3)
    plain = {r.doc_id: r.text for r in without_repeats(frame(rows)).collect()}
    named = frame(rows)
    for name in ("spans", "spans_", "key", "part", "cls", "role", "salt", "held_out", "begin"):
        named = named.withColumn(name, F.col("doc_id") + 1)
    out = without_repeats(named)
    assert out.schema == named.schema
    assert {r.doc_id: (r.text, r.spans) for r in out.collect()} == {d: (t, d + 1) for d, t in plain.items()}


def test_odd_rows(frame, prose):
    text = prose(40, 1)
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "y" * 100), (6, "y" * 100), (7, "z" * 5000), (8, "ab" * 3000), (9, "é" * 400), (10, text), (11, text), (12, text[:99]), (13, "q" + text + "q"), (14, "ab" * 200 + text)]
    rows += [(15, "\0" * 300 + text), (16, "w" * 70_000 + text)]
    assert sorted(map(tuple, deduplicated(frame([*rows, (None, text)])).collect())) == brute(rows, 100)


def test_repeated_equal_rows_count_as_one(frame, prose):
    text = prose(60, 3)
    got = sorted(map(tuple, deduplicated(frame([(5, text), (5, text), (6, text)])).collect()))
    assert got == sorted([brute([(5, text)], 100)[0]] * 2 + [brute([(5, text), (6, text)], 100)[1]])


def test_rows_that_share_an_id_keep_what_stands_once(frame, prose):
    passage, own, other = prose(40, 1)[:200], prose(60, 2)[:406], prose(20, 3)[:55]
    rows = [(1, passage), (5, passage + other), (5, own), (5, own), (None, passage)]
    got = sorted((r.doc_id, r.text) for r in without_repeats(frame(rows)).collect() if r.doc_id is not None)
    assert got == sorted([(1, passage), (5, other), (5, own), (5, own)])
    assert sorted((r.n_bytes, r.n_removed) for r in deduplicated(frame(rows)).collect()) == sorted([(200, 0), (200 + len(other), 200), (len(own), 0), (len(own), 0)])


@pytest.mark.parametrize("seed", [5, 6])
def test_shared_ids_like_brute_force(frame, prose, seed):
    rows = frame([(d % 13, t) for d, t in passages(prose, seed)])
    ordered = rows.select("doc_id", "text").distinct().orderBy("doc_id", F.xxhash64("text"), F.hash("text")).collect()
    want = brute([(k, r.text) for k, r in enumerate(ordered)], 100)
    assert sorted(map(tuple, deduplicated(rows).collect())) == sorted((ordered[k].doc_id, *x) for k, *x in want)


def test_empty_table(frame):
    assert deduplicated(frame([])).collect() == []


def test_kept_texts(frame, prose):
    rows = [*passages(prose, 4), (900, None), (901, "")]
    out = {r.doc_id: r for r in without_repeats(frame(rows)).collect()}
    for d, text, gone in covered(rows, 100):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode()
        if d == 900:
            assert out[d].text is None
        else:
            assert (out[d].text, out[d].n_chars, out[d].lang) == (kept, len(kept), "en")


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    text = np.append(rng.integers(2, 2 + letters, 700), 0)
    order = suffix_array(text, 1000)
    want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
    assert order.tolist() == want
    before, common = permuted_common_prefixes(text.astype(np.uint8), order, np.full(len(text), len(text) - 1))
    for k in range(1, len(want)):
        a, b = want[k - 1], want[k]
        n = 0
        while max(a, b) + n < len(text) - 1 and text[a + n] == text[b + n]:
            n += 1
        assert (before[b], common[b]) == (a, n)


def test_repeats_within_and_between_parts():
    rng = random.Random(1)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        seen, want = set(), []
        for p in parts:
            own = []
            for k in range(len(p) - 7):
                own.append(p[k : k + 8] in seen)
                seen.add(p[k : k + 8])
            want.append(own)
        assert [x.tolist() for x in repeats(parts, 8)] == want
