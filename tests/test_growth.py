"""Steps whose work must not outgrow their input, and rules that only larger tables reach."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from oracle import SMALL, connection, difference
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from shelfmark.operators import clusters as C
from shelfmark.operators import ingest as I
from shelfmark.operators import matching as M
from shelfmark.plans import adapter as A
from shelfmark.plans.staging import tasks_for
from shelfmark.queries.registry import ORACLES, QUERIES
from shelfmark.sources import archive as S

ITEM = "id long, store_id int, title string, author string, publisher string, editions array<string>, set_volumes int, volume int, pub_ym string, isbn13 string, list_price long"


def test_fill_candidates_meet_by_month_and_publisher(spark):
    """Like authors alone make no candidate: a known month or publisher that differs rejects the pair."""
    row = lambda i, store, title, author, publisher, month: (i, store, title, author, publisher, [], None, None, month, None, None)
    items = spark.createDataFrame([
        row(1, 1, "abcdefgh", "writer101", "house", "2001-01"), row(2, 2, "abcdexyz", "writer102", "house", "2001-01"), row(3, 2, "abcdexyw", "writer102", "house", "2001-02"),
        row(4, 2, "abcdexyv", "writer102", "quite", "2001-01"), row(5, 2, "abcdexyu", "writer102", "house", None), row(6, 2, "abcdefgh", "nobody", None, "2009-09")], ITEM)
    assert {tuple(r) for r in M.fill_candidates(items, 70).where("a = 1").collect()} == {(1, 2), (1, 5), (1, 6)}
    sided = items.withColumn("s", F.when(F.col("id").isin(1, 5), "open").otherwise("single"))
    assert {tuple(r) for r in M.fill_candidates(sided, 70, "s").where("a = 1").collect()} == {(1, 2), (1, 6)}


@pytest.mark.parametrize("name", ["price_context", "price_parse"])
def test_prices_of_high_event_numbers(spark, tmp_path, name):
    """The numbers of a table of sixty times the events."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.withColumn("event_id", F.col("event_id") + 5_900_000).write.parquet(f"{tmp_path}/events.parquet")
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(QUERIES[name](spark, str(tmp_path)), ORACLES[name], con) == ""


def test_ranks_are_written_once_an_item_and_month(spark):
    A.rankings(spark, SMALL)
    (path,) = (v for (app, d, _), v in A._WRITTEN.items() if app == spark.sparkContext.applicationId and d == SMALL and "rank" in v.rsplit("/", 1)[1])
    months = A.table(spark, SMALL, "lineitem").select(F.trunc("l_shipdate", "month"), F.col("l_suppkey") % 3, "l_partkey").distinct().count()
    assert spark.read.parquet(path).count() == months


@pytest.mark.parametrize("name", ["book_history", "trim_by_list"])
def test_lists_are_not_shuffled_for_a_short_table(spark, name):
    """However large the tables are estimated, which a threshold of -1 stands for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "BroadcastHashJoin" in joins[0]


def test_names_come_to_an_items_month_once(spark):
    """readable_export deals a row an item and month to the titles, not one for each of its lists."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["readable_export"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = [line for line in plan.splitlines() if "Join " in line or "Generate " in line]
    assert "Generate" in steps[0] and sum("Generate" in s for s in steps) == 1 and sum("SortMergeJoin" in s for s in steps) == 1


def test_a_list_is_no_window_of_one_task(spark):
    """What a list has dropped is summed from its items; of equal items the first rank stays, a null rank before all."""
    rows = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("a", 3, 7), (None, 1, 5), (None, None, 5), (None, 2, None)], "list string, rank int, item long")
    out = I.dedupe_ranks(rows, ["list"], "item", "rank")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("a", 1, 7, True), ("a", 2, 8, True), (None, None, 5, True), (None, 2, None, True)}


def test_an_archive_deals_rows_and_not_lines(spark):
    """Lines are made behind the shuffle, unless the rows have no order."""
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "day string, n int, t string")
    told = lambda df: S.dealt_lines(df, "day", 4)._jdf.queryExecution().analyzed().toString()
    plan = told(rows)
    assert plan.index("to_json") < plan.index("RepartitionByExpression")
    plan = told(rows.withColumn("n", F.col("n") * 1.5))
    assert plan.index("RepartitionByExpression") < plan.index("to_json")
    assert sorted(r.line for r in S.dealt_lines(rows, "day", 4).collect()) == ['{"day":"a","n":1,"t":null}', '{"day":"b","n":2,"t":"x"}']


@pytest.mark.parametrize("least", [0.2, 0.5, 0.6, 0.78, 1.0])
def test_alike_titles_equal_brute_force(spark, least):
    """Titles of one to twelve letters, so that one bigram, two or more must be in common."""
    rng = random.Random(3)
    rows = [(i, rng.choice("pq"), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) if rng.random() < 0.95 else None) for i in range(250)]
    grams = {i: {t[k : k + 2] for k in range(len(t) - 1)} or {t} for i, _, t in rows if t}
    key = {i: k for i, k, _ in rows}
    want = {(a, b) for a, x in grams.items() for b, y in grams.items() if a < b and key[a] == key[b] and len(x & y) >= least * len(x | y) - 1e-12}
    pairs = [tuple(r) for r in M.alike_titles(spark.createDataFrame(rows, "id long, k string, title string"), least, "k").collect()]
    assert sorted(pairs) == sorted(want) and want


def test_titles_meet_in_two_bigrams(spark):
    """Titles that share one rare bigram only are no row of any join."""
    rows = [(i, f"qz{'abcdefghijklmnoprstuvwxy'[i % 24] * 2}{'abcdefghijklmnoprstuvwxy'[i // 24] * 2}mnop{i:03d}") for i in range(400)]
    M.alike_titles(spark.createDataFrame(rows, "id long, title string").withColumn("_all", F.lit(1)), 0.78, "_all").collect()
    folder = spark.conf.get("spark.checkpoint.dir")
    index = max(Path(folder).glob("gram-index-*"), key=lambda p: p.stat().st_mtime)
    largest = spark.read.parquet(str(index)).groupBy("code").count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_repair_by_hand_is_one_job_of_rows(spark):
    """No cluster is a Python group of its own, and what is made is written, not made for every reader."""
    items = spark.createDataFrame([(i, "house", None, 1) for i in range(6)], "id long, publisher string, volume int, store_id int")
    links = spark.createDataFrame([(0, 1, 90, "auto_high"), (1, 2, 80, "auto_low"), (3, 4, 90, "auto_high"), (4, 5, 70, "manual_merge")], "a long, b long, score int, decision string")
    manual = spark.createDataFrame([(2, 0, "manual_split"), (3, 4, "manual_split"), (4, 5, "manual_merge")], "a long, b long, decision string")
    out = C.repair(C.components(links, items), links, manual, items)
    assert {tuple(r) for r in out.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 4)}
    assert "Python" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan


@pytest.mark.parametrize("name", ["archive_check", "archive_roundtrip", "archive_seal", "archive_broken_seal"])
def test_an_archive_of_lists_has_a_line_an_item_and_month(spark, name, monkeypatch):
    """The lists are told of the lines as they come back; results equal the SQL over all lists."""
    lines, real = [], S.write_archive
    monkeypatch.setattr(S, "write_archive", lambda df, *more: lines.append(df.count()) or real(df, *more))
    assert difference(QUERIES[name](spark, SMALL), ORACLES[name], connection()) == ""
    assert lines[0] == A.ranks(spark, SMALL).count()


def test_a_day_is_no_text_made_at_each_comparison(spark):
    """The sort's keys are columns, and tasks are not put together by their bytes."""
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, n int").withColumn("day", F.col("day").cast("date"))
    plan = S.dealt_lines(rows, "day", 4)._jdf.queryExecution().optimizedPlan().toString()
    (sort,) = (line for line in plan.splitlines() if "Sort [" in line)
    assert "cast(" not in sort and "RepartitionByExpression" in plan
    assert S.dealt_lines(rows, "day", 4).rdd.getNumPartitions() == tasks_for(spark)
