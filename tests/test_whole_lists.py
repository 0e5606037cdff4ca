"""Queries over whole lists and all books: cases that a prefix of the lists or of the ids gets wrong."""

from __future__ import annotations

from oracle import SMALL

from shelfmark.operators.ingest import twin_lists
from shelfmark.operators.price import never_ranked
from shelfmark.queries.registry import QUERIES


def test_rank_status_has_every_book_three_times(spark):
    more = SMALL.replace("sf0.001", "sf0.01")
    assert QUERIES["rank_status_whole"](spark, more).count() == 3 * spark.read.parquet(f"{more}/part.parquet").count() > 3 * 200


def test_lists_that_differ_from_the_fourth_rank_on_are_no_twins(spark):
    lists = {"a": [1, 2, 3, 4], "b": [1, 2, 3, 5], "c": [4, 3, 2, 1], "d": [1, 2, 3]}
    rows = spark.createDataFrame([(k, r, i) for k, own in lists.items() for r, i in enumerate(own, 1)], "name string, rank int, part long")
    assert sorted((r.name, r.n, r.twins) for r in twin_lists(rows, ["name"], "part").collect()) == [("a", 4, 2), ("c", 4, 2)]
    assert twin_lists(rows.where("rank <= 3"), ["name"], "part").count() == 3


def test_an_item_of_any_rank_in_any_list_was_ranked(spark):
    items = spark.createDataFrame([(k, 1, k) for k in range(1, 5)], "store_book_id long, store_id int, book_id long")
    lists = spark.createDataFrame([(1, "online", "all", 1), (2, "online", "all", 21), (3, "weekly", "PROMO", 300)], "store_book_id long, kind string, unified string, rank int")
    assert [r.store_book_id for r in never_ranked(items, lists).collect()] == [4]
