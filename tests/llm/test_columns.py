"""Further columns, named like the ones that the operators use themselves, change nothing and are carried along by the stages."""

from __future__ import annotations

import public_tokenizers
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import quality, toxicity
from shelfmark.llm.chat import format_chats, read_back
from shelfmark.llm.common import fresh_name, shared_folder
from shelfmark.llm.decontam import contaminated
from shelfmark.llm.media import store_texts
from shelfmark.llm.ngram_join import ngram_jaccard_join, ngram_jaccard_links
from shelfmark.llm.packing import pack
from shelfmark.llm.suffix_dedup import deduplicated
from shelfmark.llm.token_counts import WORDS, deltas
from shelfmark.llm.url_filter import filter_urls

NAMES = ["key", "part", "cls", "spans", "Spans_", "role", "salt", "held_out", "root", "own", "hit", "score", "n", "sequence_id", "media", "word", "label", "x", "item_id", "begin", "end", "n_bytes", "rule", "host", "tokenizer", "sign"]
LABELS = "doc_id long, quality int, toxic int"


def odd(df):
    return df.select("*", *(F.lit("odd").alias(c) for c in NAMES if c not in df.columns))


@pytest.fixture(scope="module")
def docs(frame, prose):
    rows = [(k, prose(40, k // 2) + (" slur slur slur" if k % 5 == 0 else "")) for k in range(60)]
    return frame([*rows, (70, None), (71, ""), (72, prose(30, 1) + " " + prose(40, 3))])


def operators(spark):
    labels = odd(spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(60)], LABELS))
    items = odd(spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    events = lambda d: d.select(*d.columns, F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit(0).alias("seq"), F.lit("start").alias("kind"), *([] if "role" in d.columns else [F.lit("odd").alias("role")]))
    return {
        "ngram_jaccard_join": ngram_jaccard_join, "ngram_jaccard_links": ngram_jaccard_links,
        "filter_urls": lambda d: filter_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("http://a.com/"), "text")), spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")),
        "quality": lambda d: quality.score(d, quality.train(d, labels)), "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)), "store_texts": store_texts,
        "deltas": lambda d: deltas(d.withColumn("kind", F.lit("insert")), {WORDS: None}), "deduplicated": deduplicated,
        "pack": lambda d: pack(d, public_tokenizers.path("byte_bpe_50k.json")).drop("sequence_id", "offset"), "chat": lambda d: read_back(format_chats(events(d))), "contaminated": lambda d: contaminated(d, items),
    }


@pytest.mark.parametrize("name", ["ngram_jaccard_join", "ngram_jaccard_links", "filter_urls", "quality", "toxicity", "store_texts", "deltas", "deduplicated", "pack", "chat", "contaminated"])
def test_operators(spark, docs, name):
    run = operators(spark)[name]
    plain, named = (sorted(map(repr, map(tuple, run(d).collect()))) for d in (docs, odd(docs)))
    assert plain == named and (plain or name == "contaminated")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages(spark, docs, name, stage):
    plain, named = stage(spark, docs, SMALL), stage(spark, odd(docs), SMALL)
    assert named.schema == odd(docs).schema
    assert sorted(map(repr, named.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
    assert {r.spans for r in named.collect()} == {"odd"}


def test_fresh_names():
    assert fresh_name("spans", ["Spans", "spans__x"]) == "spans___" and fresh_name("spans", []) == "spans"


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
