"""The job that moves rows from a folder of tables into an archive, cut off at every point."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.sources.prune_job import Leaving, Run


class Cut(Exception):
    pass


@pytest.fixture
def folder(spark, tmp_path):
    items = spark.range(60).select("id", (F.col("id") % 20).alias("book"), F.concat(F.lit("day "), (F.col("id") % 5).cast("string")).alias("shelf"))
    books = spark.range(20).select("id", F.concat(F.lit("title\n\""), F.col("id").cast("string")).alias("title"), (F.col("id") % 3).cast("int").alias("half"))
    items.write.partitionBy("shelf").parquet(f"{tmp_path}/items")
    books.write.partitionBy("half").parquet(f"{tmp_path}/books")
    return str(tmp_path), items, books


def tables(spark, items, books):
    # Book 6, 7, 8 and 9 go with their items; shelf "day 1" loses all its rows.
    gone = items.where("book BETWEEN 6 AND 9 OR shelf = 'day 1'").select("id")
    return {"items": Leaving(items.schema, "shelf", gone.unionByName(gone).unionByName(spark.createDataFrame([(None,)], "id long"))), "books": Leaving(books.schema, "half", books.where("id BETWEEN 6 AND 9").select("id"))}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_run_cut_off_at_every_point_loses_and_repeats_nothing(spark, folder):
    root, items, books = folder
    passed = set()

    def cut(point):
        if point not in passed:
            passed.add(point)
            raise Cut(point)

    for _ in range(100):
        # Another attempt names other keys: what the first one planned counts.
        leaving = tables(spark, items, books)
        if len(passed) > 4:
            leaving = {name: own._replace(keys=own.keys.limit(0)) for name, own in leaving.items()}
        run = Run(spark, root, "one", leaving, at=cut)
        try:
            report = run.finish()
            break
        except Cut:
            continue
    assert {"before plan-items", "after manifest-books", "dropped from items", "put back into items", "dropped from books", "after replaced-books"} <= passed
    assert len(passed) >= 30
    gone = [i for i in range(60) if 6 <= i % 20 <= 9 or i % 5 == 1]
    assert sorted(map(tuple, report.collect())) == [("books", "all", 4, True), ("items", "all", len(gone), True)]
    left = spark.read.parquet(f"{root}/items")
    assert ids(left) == [i for i in range(60) if i not in gone]
    assert sorted(map(tuple, left.select("id", "book", "shelf").collect())) == [(i, i % 20, f"day {i % 5}") for i in range(60) if i not in gone]
    assert ids(run.archived("items")) == gone
    assert sorted(map(tuple, run.archived("books").select("id", "title", "half").collect())) == [(i, f'title\n"{i}', i % 3) for i in range(6, 10)]
    assert ids(spark.read.parquet(f"{root}/books")) == [i for i in range(20) if not 6 <= i <= 9]


def test_partitions_that_lose_nothing_are_not_written(spark, folder):
    root, items, books = folder
    files = lambda: {p.name for p in Path(root, "items").rglob("*.parquet") if "day 3" in str(p.parent) or "day%203" in str(p.parent)}
    before = files()
    Run(spark, root, "one", {"items": Leaving(items.schema, "shelf", items.where("id % 5 = 2 AND id < 30").select("id"))}).finish()
    assert before and files() == before
    assert ids(spark.read.parquet(f"{root}/items")) == [i for i in range(60) if i % 5 != 2 or i >= 30]


def test_an_export_that_does_not_read_back_deletes_nothing(spark, folder):
    root, items, books = folder

    def spoil(point):
        if point == "after manifest-books":
            for file in Path(root, "_runs/one/export/books").rglob("*.gz"):
                file.unlink()

    report = Run(spark, root, "one", tables(spark, items, books), at=spoil).finish()
    assert not any(r.deleted for r in report.collect())
    assert spark.read.parquet(f"{root}/items").count() == 60 and spark.read.parquet(f"{root}/books").count() == 20


def test_a_key_without_a_row_deletes_nothing_of_its_group(spark, folder):
    root, items, books = folder
    keys = spark.createDataFrame([(3, "day 3"), (1003, "day 3"), (4, "day 4")], "id long, shelf string")
    report = Run(spark, root, "one", {"items": Leaving(items.schema, "shelf", keys)}, group="shelf").finish()
    assert sorted((r.group, r.deleted) for r in report.collect()) == [("day 3", False), ("day 4", True)]
    assert ids(spark.read.parquet(f"{root}/items")) == [i for i in range(60) if i != 4]


def test_days_go_one_by_one(spark, folder):
    root, items, books = folder

    def spoil(point):
        if point == "after manifest-items":
            for file in Path(root, "_runs/one/export/items").glob("day=day*2/*.gz"):
                file.unlink()

    days = spark.createDataFrame([("day 1",), ("day 2",)], "shelf string")
    report = Run(spark, root, "one", {"items": Leaving(items.schema, "shelf", days)}, "shelf", spoil).finish()
    assert sorted((r.group, r.rows, r.deleted) for r in report.collect()) == [("day 1", 12, True), ("day 2", 12, False)]
    assert ids(spark.read.parquet(f"{root}/items")) == [i for i in range(60) if i % 5 != 1]


def test_nothing_to_do(spark, folder):
    root, items, books = folder
    run = Run(spark, root, "one", {"items": Leaving(items.schema, "shelf", items.where("false").select("id"))})
    assert run.finish().collect() == [] and run.finish().collect() == []
    assert spark.read.parquet(f"{root}/items").count() == 60 and run.archived("items").count() == 0
