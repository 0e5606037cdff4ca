"""All links of the n-gram Jaccard join, not only those that hold components together, against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from oracle import SMALL, connection, difference
from test_ngram_join import near_copies

from shelfmark.llm import ngram_join
from shelfmark.llm.common import mix
from shelfmark.llm.ngram_join import Bands, class_links, digests, ngram_jaccard_join, ngram_jaccard_links, parts_of
from shelfmark.llm.queries import BESIDE, BESIDE_ORACLES


def brute(rows, words, num, den):
    """The linked pairs of row numbers."""
    sets = []
    for _, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} - {()})
    return {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and den * len(x & y) >= num * len(x | y)}


def counts(pairs, n):
    return [sum(k in p for p in pairs) for k in range(n)]


def listed(frame, rows, *how):
    """The pairs of doc_ids that class_links stands for."""
    docs, links = class_links(frame(rows), *how)
    of = {}
    for r in docs.collect():
        of.setdefault(r.cls, []).append(r.doc_id)
    of.pop(None, None)
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    pairs = {tuple(sorted((x, y))) for a, b in found for x in of[a] for y in of[b]}
    return pairs | {(x, y) for own in of.values() for x in own for y in own if x < y}


@pytest.mark.parametrize("sets", [256, 3])
@pytest.mark.parametrize(("words", "num", "den", "seed"), [(4, 85, 100, 1), (2, 60, 100, 3)])
def test_equals_brute_force(frame, prose, monkeypatch, words, num, den, seed, sets):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    rows = sorted(near_copies(prose, seed))
    want = brute(rows, words, num, den)
    got = sorted(map(tuple, ngram_jaccard_links(frame(rows), words, num, den).collect()))
    assert [r[3] for r in got] == counts(want, len(rows))
    assert [r[:3] for r in got] == sorted(map(tuple, ngram_jaccard_join(frame(rows), words, num, den).collect()))
    assert listed(frame, rows, words, num, den) == want


def test_no_link_of_a_large_group_is_lost(frame, prose):
    base = prose(120, 4).split()
    rows = [(k, " ".join([*base[: k % 100], f"x{k}", *base[k % 100 + 1 :]])) for k in range(300)] + [(300, None), (301, "")]
    want = brute(rows, 5, 80, 100)
    assert len(want) == 300 * 299 // 2
    got = {r.doc_id: r.n_links for r in ngram_jaccard_links(frame(rows)).collect()}
    assert got == dict(enumerate(counts(want, 302)))


def test_rows_that_repeat_an_id_count_one_by_one(frame, prose):
    rows = [(1, prose(50, 1)), (1, prose(50, 2)), (2, prose(50, 2)), (3, prose(50, 2) + " x"), (None, prose(50, 1))]
    assert sorted((r.doc_id, r.n_links) for r in ngram_jaccard_links(frame(rows)).collect()) == [(1, 0), (1, 2), (2, 2), (3, 2)]


@pytest.mark.parametrize("name", sorted(BESIDE_ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert difference(BESIDE[name](spark, SMALL), BESIDE_ORACLES[name], connection()) == ""


def test_empty_table(frame):
    assert ngram_jaccard_links(frame([])).collect() == []


def test_digests_and_parts_of_many_sets_in_one_pass():
    """The values that sets taken one by one had; an empty set amid others takes nothing of them."""
    a = np.sort(mix(np.arange(1, 9, dtype=np.uint64)))
    cls, check = digests([a, a[:0], a[:1], a[:0]])
    assert cls.tolist() == [6700754434738972403, 0, -8631314881253153158, 0] and check.tolist() == [4323554576567205842, 0, 1238383602690714843, 0]
    assert [(len(p), int(np.bitwise_xor.reduce(p))) for p in parts_of([a, a[:1]], Bands(85, 100))] == [(2, 3801069770206336730), (1, 7996378503476682859)]
