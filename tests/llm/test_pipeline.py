"""The corpus pipeline, stage by stage, against brute force on the stage's own input."""

from __future__ import annotations

import public_tokenizers
import pytest
from oracle import SMALL
from test_decontam import brute as contaminated_pairs
from test_ngram_join import brute as components
from test_packing import held, library  # noqa: F401
from test_suffix_dedup import covered

import corpus_pipeline
from shelfmark.llm import toxicity
from shelfmark.llm.common import staged


@pytest.fixture(scope="module")
def states(spark):
    """What each stage was given, and at last what came out."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SMALL), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_names_and_columns(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    for df in states[1:-1]:
        assert df.dtypes == states[0].dtypes


def test_toxic_documents_go(spark, states):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = toxicity.score(states[0], toxicity.train(states[0], labels)).collect()
    assert set(texts(states[1])) == {r.doc_id for r in rows if not r.predicted}


def test_one_of_each_group_stays(states):
    before, after = texts(states[1]), texts(states[2])
    assert after == {d: before[d] for d, _, c in components(sorted(before.items()), 5, 80, 100) if d == c}


def test_repeated_passages_go(states):
    before, after = texts(states[2]), texts(states[3])
    assert set(after) == set(before)
    for d, text, gone in covered(before.items(), 100):
        assert (after[d] or "") == bytes(b for b, g in zip(text, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_benchmark_passages_go(spark, states):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(states[3]), texts(states[4])
    few = {d: t for d, t in before.items() if len(t or "") < 2000}
    hit = {d for d, _ in contaminated_pairs(few.items(), items)}
    assert set(after) & set(few) == set(few) - hit
    assert all(after[d] == before[d] for d in after)


def test_all_that_is_left_is_packed(states, library):  # noqa: F811
    rows = sorted(texts(states[4]).items())
    lanes, total = held(rows, states[5].collect(), library, 1024)
    assert lanes <= -(-total // 1024) + 2


def test_run_gives_the_last_stage(spark, states):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in got.select("doc_id").distinct().collect()) == sorted(texts(states[4]))


def test_stages_stand_odd_rows(spark, frame, prose):
    docs = frame([(1, None), (2, ""), (3, prose(30, 1)), (4, prose(30, 1)), (5, prose(90_000, 2)), (None, "x y z")])
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), "odd")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 5}


def test_stages_stand_an_empty_table(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), "none")
    assert docs.count() == 0


def test_tokenizer_file_is_outside_the_repository():
    assert "/root/repo" not in public_tokenizers.path("byte_bpe_50k.json")
