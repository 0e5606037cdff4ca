from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm.token_counts import WORDS, TokenRollup, deltas

PATH = public_tokenizers.path("byte_bpe_50k.json")
BOTH = {"bpe/1": PATH, WORDS: None}
SCHEMA = "kind string, source string, lang string, text string, old_source string, old_lang string, old_text string"


def counted(rows):
    own = Tokenizer.from_file(PATH)
    out = {}
    for source, lang, text in rows:
        for name, n in (("bpe/1", len(own.encode(text or "", add_special_tokens=False).ids)), (WORDS, len((text or "").split()))):
            total = out.setdefault((source, lang, name), [0, 0, 0])
            for k, x in enumerate((1, n, len(text or ""))):
                total[k] += x
    return {k: tuple(v) for k, v in out.items()}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}


def test_commits_are_idempotent_and_signed(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), BOTH)
    assert totals(rollup) == {}
    first = [("a", "en", "one two"), ("a", "en", ""), ("b", None, None), (None, "fr", "été <|endoftext|> x")]
    batch = spark.createDataFrame([("insert", *r, None, None, None) for r in first], SCHEMA)
    assert rollup.commit("day/1", batch) and not rollup.commit("day/1", batch)
    assert totals(rollup) == counted(first)
    second = [("revise", "b", "en", "now some words", "b", None, None), ("delete", None, None, None, "a", "en", "one two"), ("insert", "c", "en", "new", None, None, None), ("insert", "c", "en", "new", None, None, None)]
    assert rollup.commit("day/2", spark.createDataFrame(second, SCHEMA))
    assert totals(rollup) == counted([("a", "en", ""), ("b", "en", "now some words"), (None, "fr", "été <|endoftext|> x"), ("c", "en", "new"), ("c", "en", "new")])


def test_a_commit_that_broke_off_is_written_anew(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), {WORDS: None})
    batch = spark.createDataFrame([("insert", "a", "en", "x y", None, None, None)], SCHEMA)
    rollup.commit("1", batch)
    (tmp_path / "rollup" / "batch=1" / "_SUCCESS").unlink()
    assert totals(rollup) == {}
    assert rollup.commit("1", batch)
    assert totals(rollup) == {("a", "en", WORDS): (1, 2, 3)}


def test_empty_batch_and_inserts_alone(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), {WORDS: None})
    none = spark.createDataFrame([], SCHEMA)
    assert rollup.commit("0", none) and not rollup.commit("0", none)
    assert totals(rollup) == {}
    inserts = spark.createDataFrame([("insert", "a", "en", "x " * 50_000, "extra")], "kind string, source string, lang string, text string, tokenizer string")
    assert [r.tokens for r in deltas(inserts, {WORDS: None}).collect()] == [50_000]


def test_changes_that_cannot_be_counted_are_errors(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), {WORDS: None})
    for kind in ("oops", None):
        with pytest.raises(Exception, match="unknown kind"):
            rollup.commit("1", spark.createDataFrame([(kind, "a", "en", "x", "a", "en", "x")], SCHEMA))
    for kind in ("revise", "delete"):
        with pytest.raises(Exception, match="no old rows"):
            rollup.commit("1", spark.createDataFrame([(kind, "a", "en", "x")], "kind string, source string, lang string, text string"))
    assert totals(rollup) == {} and not rollup.committed("1")
