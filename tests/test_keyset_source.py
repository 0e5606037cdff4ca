"""Reading a database by key ranges in pages, held against the table that was put into it."""

from __future__ import annotations

import random
import sqlite3

import pyarrow.parquet as pq
import pytest
from oracle import SMALL
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfmark.sources.keyset import KeysetSource, Table
from shelfmark.sources.keyset import KeyRange as Range

SCHEMA = "part long, title string, price double"


@pytest.fixture(scope="module")
def keyed(spark):
    spark.dataSource.register(KeysetSource)
    return spark


def put(path, rows, unique=True):
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "the items" (part INTEGER {"UNIQUE" if unique else ""}, title TEXT, price REAL, more TEXT)')
        db.executemany('INSERT INTO "the items" VALUES (?, ?, ?, NULL)', rows)


def parts():
    t = pq.read_table(f"{SMALL}/part.parquet").to_pydict()
    return [(k, name, float(price)) for k, name, price in zip(t["p_partkey"], t["p_name"], t["p_retailprice"], strict=True)]


def options(path, **more):
    return {"connect": "sqlite3", "target": str(path), "table": "the items", "key": "part"} | {k: str(v) for k, v in more.items()}


@pytest.mark.parametrize(("ranges", "pages"), [(1, 1), (7, 3), (3, 7), (50, 200), (10_000, 10)])
def test_equals_the_table(keyed, tmp_path, ranges, pages):
    rows = random.Random(ranges).sample([*parts(), (10**12, None, None), (-5, "", 0.5)], 60)
    put(tmp_path / "db", rows)
    got = keyed.read.format("keyset").schema(SCHEMA).options(**options(tmp_path / "db", range_rows=ranges, page_rows=pages)).load()
    assert got.rdd.getNumPartitions() == -(-60 // ranges)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_a_page_is_bounded_and_begins_after_the_one_before(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    put(tmp_path / "db", [(3 * k, None, None) for k in range(25)])
    table = Table(options(tmp_path / "db", range_rows=10, page_rows=4), StructType([StructField("part", LongType())]))
    assert table.ranges() == [Range(None, 27), Range(27, 57), Range(57, 72)]
    assert [b.column(0).to_pylist() for b in table.pages(Range(27, 57))] == [[30, 33, 36, 39], [42, 45, 48, 51], [54, 57]]


def test_comparisons_of_the_key_reach_the_database(keyed, tmp_path):
    put(tmp_path / "db", [(k, str(k), None) for k in range(100)])
    keyed.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        source = keyed.read.format("keyset").schema(SCHEMA).options(**options(tmp_path / "db", range_rows=10, push_filters="true")).load()
        some = source.where((F.col("part") > 40) & (F.col("part") <= 65) & (F.col("title") != "50"))
        assert some.rdd.getNumPartitions() == 3
        assert sorted(r.part for r in some.collect()) == [k for k in range(41, 66) if k != 50]
    finally:
        keyed.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_table(keyed, tmp_path):
    put(tmp_path / "db", [])
    assert keyed.read.format("keyset").schema(SCHEMA).options(**options(tmp_path / "db")).load().collect() == []


@pytest.mark.parametrize(("rows", "says"), [([(1, "a", 1.0), (2, "b", None), (2, "c", None), (3, "d", None)], "more than once"), ([(None, "a", 1.0), (1, "b", None)], "is null")])
def test_keys_that_could_lose_rows_are_errors(keyed, tmp_path, rows, says):
    put(tmp_path / "db", rows, unique=False)
    with pytest.raises(PySparkException, match=says):
        keyed.read.format("keyset").schema(SCHEMA).options(**options(tmp_path / "db", page_rows=2)).load().collect()


def test_a_stream_goes_on_behind_the_last_key(keyed, tmp_path):
    rows = sorted(parts())[:90]
    out = tmp_path / "out"

    def run():
        stream = keyed.readStream.format("keyset").schema(SCHEMA).options(**options(tmp_path / "db", range_rows=8, page_rows=3)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start(str(out))
        assert query.awaitTermination(120)
        return sorted(map(tuple, keyed.read.schema(SCHEMA).parquet(str(out)).collect()))

    put(tmp_path / "db", [])
    assert run() == []
    put(tmp_path / "db", rows[:40])
    assert run() == rows[:40]
    assert run() == rows[:40]
    put(tmp_path / "db", rows[40:])
    assert run() == rows
