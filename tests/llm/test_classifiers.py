"""Held-out accuracy and odd inputs of the quality ranking and the toxicity classifier."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
import zstandard

from shelfmark.llm import quality, toxicity
from shelfmark.llm.labelled import sample
from shelfmark.llm.toxicity import Distance, tile

TABLES = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, module, label):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.score(docs, module.train(docs, labels)).join(labels.select("doc_id", label), "doc_id").where("held_out").collect()
    return [(r.score, r.predicted, r[label]) for r in rows]


def balanced(rows):
    return sum(sum(p == y for _, p, y in rows if y == k) / sum(y == k for *_, y in rows) for k in (0, 1)) / 2


def ranked(rows):
    """Share of (1, 0) pairs in right order."""
    ones, zeros = ([s for s, _, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.85), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    rows = held_out(spark, module, label)
    assert len(rows) > 100
    assert all(0 <= s <= 1 for s, *_ in rows)
    assert balanced(rows) > least and ranked(rows) > least


def plain_features(raw):
    """What quality describes a text by, counted byte by byte."""
    groups = [b"!", b"|", b"$#%&*@^~=+<>{}[]\\_`", b".,;:?'\"()-/"]
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if 65 <= b < 91 else 2 if 97 <= b < 123 else 3 if 48 <= b < 58 else next((k for k, g in enumerate(groups, 4) if b in g), 9 if b > 127 else 8)
    count = [0] * 10
    for b in raw:
        count[kind(b)] += 1
    words = re.findall(rb"[^ \t\n\v\f\r]+", raw.translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))))
    lines, n, long = raw.split(b"\n"), max(len(words), 1), math.log1p(len(words))
    variety = len(set(words)) / n
    share = [count[k] / max(len(raw), 1) for k in (0, 1, 3, 4, 5, 6, 7, 8, 9)]
    return [*share, variety, variety * max(long, 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines), long, min(len(raw) / n, 40), len(lines) / n]


def test_quality_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{TABLES.replace('sf0.1', 'sf0.001')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = (np.array(plain_features((r.text or "").encode())) - model.mean) / model.scale
        raw = float(np.clip(x, -6, 6) @ model.weights)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * (raw - model.cut) + math.log(0.7 / 0.3))))))


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{TABLES.replace('sf0.1', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.distance is not None
    toxic, ordinary = (zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for x in model.distance.sides)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 3000]
    assert len(rows) > 300
    for r in rows:
        words = [w[k : k + 64] for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode()) for k in range(0, len(w), 64)]
        gains = []
        for w in words:
            w = b" " + bytes(b + 32 if 65 <= b < 91 else b for b in w) + b" "
            window = w * (1 + 24 // len(w))
            gain = len(ordinary.compress(window)) - len(toxic.compress(window))
            gains += [(w, gain)] if gain >= 3 else []
        long = math.log(10 + len(words))
        x = [1, math.log1p(len(gains)), math.log1p(len({w for w, _ in gains})), math.log1p(sum(g for _, g in gains)), math.log1p(len(gains)) / long, long]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.weights)))))))


def test_an_id_counts_once_in_the_sample(spark, frame, prose):
    docs = frame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, None)])
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 0, 0), (4, 1, 1)], LABELS)
    rows = sample(docs, labels, "quality", 7, 99, 10).collect()
    assert sorted((r.doc_id, r.text or "", r.label) for r in rows) == [(1, "a", 0), (2, "c", 1), (3, "", 0)]


@pytest.mark.parametrize(("module", "of", "remainder"), [(quality, 4, 2), (toxicity, 5, 0)])
def test_odd_rows(spark, frame, prose, module, of, remainder):
    rows = [(None, "x"), (1, None), (2, ""), (3, " \n "), (4, "w" * 300_000), (5, prose(50_000, 1)), *((k, prose(30, k) + (" slur slur slur" if k % 3 else "")) for k in range(10, 90)), (10, prose(30, 10)), (6, "\0\xad")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 > 0)) for k in range(10, 90)] + [(None, 1, 1), (11, None, None), (12, 7, 7)], LABELS)
    model = module.train(frame(rows), labels)
    got = module.score(frame(rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % of == remainder)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_one_kind_or_none(spark, frame, prose, module):
    docs = frame([(k, prose(20, k)) for k in range(20)])
    for labels in ([], [(k, 1, 1) for k in range(20)]):
        rows = module.score(docs, module.train(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert len(rows) == 20 and len({r.score for r in rows}) == 1
    model = module.train(docs, spark.createDataFrame([], LABELS))
    assert module.score(docs.limit(0), model).collect() == []


def test_held_out_labels_do_not_reach_the_model(spark, frame, prose):
    docs = frame([(k, prose(30, k) + (" slur slur" if k % 2 else "")) for k in range(120)])
    rows = [(k, k % 2, k % 2) for k in range(120)]
    for module, of, remainder in ((quality, 4, 2), (toxicity, 5, 0)):
        turned = [(k, 1 - q, 1 - t) if zlib.crc32(str(k).encode()) % of == remainder else (k, q, t) for k, q, t in rows]
        scores = [sorted(map(tuple, module.score(docs, module.train(docs, spark.createDataFrame(x, LABELS))).collect())) for x in (rows, turned)]
        assert scores[0] == scores[1]


def test_toxic_documents_go_and_columns_stay(spark, frame, prose):
    rows = [(k, prose(30, k) + (" vilestword vilestword awfulname" if k % 2 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(150)], LABELS)
    kept = toxicity.without_toxic(frame(rows), toxicity.train(frame(rows), labels))
    assert kept.schema == frame(rows).schema
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 200, 2))


def test_compression_distance_tells_dictionaries_apart():
    distance = Distance(b"".join(map(tile, [b"grobian", b"flegel"])), b"".join(map(tile, [b"garten", b"wiese"])))
    assert distance[b"grobian"] > 0 and distance[b"wiese"] == 0 and distance[b"unseen"] == 0
