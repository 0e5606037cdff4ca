"""The registered queries on the smallest tables: against their SQL, or against brute force."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pytest
from oracle import SMALL, connection, difference
from test_decontam import brute as contaminated_pairs
from test_media import padded
from test_packing import held, library  # noqa: F401
from test_token_counts import counted

from shelfmark.llm.queries import BESIDE, BESIDE_ORACLES, ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), ORACLES[name], con) == ""


def test_changes_are_counted_as_their_oracle_says(spark, con):
    assert difference(BESIDE["token_count_changes"](spark, SMALL), BESIDE_ORACLES["token_count_changes"], con) == ""


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op4_media(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op4_media_columns"](spark, SMALL).collect()}
    assert len(got) == len(documents)
    for d, text in documents:
        want = padded(text)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len((text or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


def test_op5_token_counts(spark):
    rows = [(r.source, r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {(s, lang, {"bpe/1": "byte_bpe_50k/1"}.get(t, t)): v for (s, lang, t), v in counted(rows).items()}
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in QUERIES["op5_token_counts"](spark, SMALL).collect()} == want


def test_op7_packing(spark, documents, library):  # noqa: F811
    lanes, total = held(documents, QUERIES["op7_best_fit_packing"](spark, SMALL).collect(), library, 1024)
    assert lanes <= -(-total // 1024) + 2


def test_op10_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    few = [x for x in documents if len(x[1] or "") < 3000][:60] + [x for x in documents if 4000 < len(x[1] or "") < 9000][:4]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()}
    ids = {d for d, _ in few}
    assert {x for x in got if x[0] in ids} == contaminated_pairs(few, items)


@pytest.mark.parametrize(("name", "of", "remainder", "threshold"), [("op3_quality_classifier", 4, 2, 0.7), ("op9_toxicity", 5, 0, 0.5)])
def test_classifiers(spark, documents, name, of, remainder, threshold):
    rows = QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_tokenizer_is_a_parameter():
    assert public_tokenizers.path("byte_bpe_50k.json").endswith("byte_bpe_50k.json")
