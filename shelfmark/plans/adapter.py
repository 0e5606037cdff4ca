"""Ranked-list tables derived from the star-schema tables.

stores, categories, books, store_books, rankings and the rest are plain DataFrames over the given tables, so filters on
a snapshot date or a store reach the windows' partition keys and the scans. Only integers decide an order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.plans.staging import shared_folder

STORES = (1, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, title, author, publisher, pub_ym."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("book_id"),
        F.concat_ws(" ", "p_name", key.cast("string")).alias("title"),
        F.concat(F.lit("A"), (key % 97).cast("string")).alias("author"),
        F.col("p_brand").alias("publisher"),
        F.concat((2000 + key % 20).cast("string"), F.lit("-"), F.lpad((key % 12 + 1).cast("string"), 2, "0")).alias("pub_ym"),
    )


def derived_store_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_book_id, store_id, part, book_id (null: not matched), title, list_price in cents (null: unknown)."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("store_id")).distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    price = F.when(F.col("part") % 13 == 0, F.lit(None)).otherwise(F.col("cents") + F.when((F.col("part") % 7 == 0) & (F.col("store_id") == 2), 500).otherwise(0))
    return pairs.join(part, "part").select(
        (F.col("part") * 3 + F.col("store_id")).alias("store_book_id"), "store_id", "part",
        F.when(F.col("part") % 11 != 0, F.col("part")).alias("book_id"),
        F.concat_ws(" ", "p_name", F.col("part").cast("string")).alias("title"), price.cast("long").alias("list_price"),
    )


#: Where this process has written derived tables, by application, folder and name.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(derived: DataFrame, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """derived, written once for each application and folder, by a column if one is given. The given tables do not change while an application runs."""
    spark = derived.sparkSession
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        (derived.write.partitionBy(by) if by else derived.write).parquet(path)
        _WRITTEN[at] = path
    return spark.read.schema(derived.schema).parquet(_WRITTEN[at]).select(*derived.columns)


def store_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `derived_store_books`, written once."""
    return _written(derived_store_books(spark, sf_dir), sf_dir, "store-books")


#: The lists that a month's items of a store stand in: kind, whether of all items or of one part type, and what ranks them.
LISTS = (("online", True, "quantity"), ("online", False, "quantity"), ("weekly", True, "cents"), ("weekly", False, "cents"), ("offline", True, "lines"))

#: Lines that a task sums and ranks, and the most tasks that share them: a month of a store is ranked by one task, and there are some 250 of these.
LINES_A_TASK, MOST_TASKS = 100_000, 1024


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `derived_rankings`; the ranks of an item's month are written once, by snapshot_date.

    All queries over lists read this table, so a filter on dates opens the folders of these dates only, and no query ranks
    the whole history anew. An item's month is one row of the files, and is told for each of its lists as it is read.
    """
    return listed_ranks(ranks(spark, sf_dir))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `derived_ranks`, written once."""
    return _written(derived_ranks(spark, sf_dir), sf_dir, "ranks", "snapshot_date")


def derived_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_date, store_id, kind (online, weekly, offline), unified, rank, store_book_id, part, sales_point.

    online lists rank by quantity, weekly ones by revenue, offline ones by number of lines; ties by part. The online and
    weekly lists exist for every part type and for 'all', the offline ones for 'all' only.
    """
    return listed_ranks(derived_ranks(spark, sf_dir))


def derived_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_date, store_id, part, type, sales_point, and r0, r1, ...: the ranks in LISTS. One row for each item and month.

    Lines are dealt by part, where they are summed and get their part's type, then by month and store, where all lists rank them.
    """
    given = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, min(MOST_TASKS, given.count() // LINES_A_TASK))
    lines = given.select(
        F.trunc("l_shipdate", "month").alias("snapshot_date"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("store_id"), F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    ).repartition(tasks, "part").groupBy("snapshot_date", "store_id", "part").agg(F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"), F.count("*").alias("lines"))
    rows = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("type")), "part").repartition(tasks, "snapshot_date", "store_id")
    for k, (_, all_items, by) in enumerate(LISTS):
        own = W.partitionBy("snapshot_date", "store_id", *(() if all_items else ("type",))).orderBy(F.desc(by), "part")
        rows = rows.withColumn(f"r{k}", F.row_number().over(own))
    sales = F.when(F.col("store_id") != 1, F.col("quantity")).cast("int").alias("sales_point")
    return rows.select("snapshot_date", "store_id", "part", "type", sales, *(f"r{k}" for k in range(len(LISTS))))


def listed_ranks(ranks: DataFrame) -> DataFrame:
    """The rows of `derived_rankings` of those of `derived_ranks`."""
    rows = ranks.select("snapshot_date", "store_id", "part", "sales_point", F.inline(lists_of_ranks()))
    return rows.select("snapshot_date", "store_id", "kind", "unified", "rank", (F.col("part") * 3 + F.col("store_id")).alias("store_book_id"), "part", "sales_point")


def lists_of_ranks() -> Column:
    """kind, unified and rank of the lists that a row of `derived_ranks` stands in."""
    return F.array(*(F.struct(F.lit(kind).alias("kind"), (F.lit("all") if all_items else F.col("type")).alias("unified"), F.col(f"r{k}").alias("rank")) for k, (kind, all_items, _) in enumerate(LISTS)))


def crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, store_id, snapshot_date, status, items, finished (null: never)."""
    return logs_of(table(spark, sf_dir, "events"))


def logs_of(events: DataFrame) -> DataFrame:
    """The rows of `crawl_logs` of events, which may be a stream."""
    return events.select(
        F.col("event_id").alias("log_id"), (F.col("user_id") % 3 + 1).cast("int").alias("store_id"), F.to_date("ts").alias("snapshot_date"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.floor("value").cast("int").alias("items"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("finished"), F.col("event_type"), F.col("user_id"),
    )


def book_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b (store_book ids, a < b), score 60 to 100, decision, auto_decision (null: not recorded)."""
    items = store_books(spark, sf_dir).select("store_book_id", "part", "store_id")
    x, y = items.alias("x"), items.alias("y")
    pairs = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.store_book_id") < F.col("y.store_book_id")))
    pairs = pairs.select(F.col("x.store_book_id").alias("a"), F.col("y.store_book_id").alias("b"), F.col("x.part").alias("part"))
    key = F.col("part") * 3 + F.col("a") % 3 + F.col("b") % 3
    score = (60 + key % 41).cast("int")
    auto = F.when(score >= 85, "auto_high").when(score >= 65, "auto_low").otherwise("rejected")
    decision = F.when(key % 17 == 0, "manual_merge").when(key % 19 == 0, "manual_split").otherwise(auto)
    return pairs.select("a", "b", "part", score.alias("score"), decision.alias("decision"), F.when(key % 29 != 0, auto).alias("auto_decision"))


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id (null: the book is gone), title as last seen."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(orders, "l_orderkey").select("user_id", "part").distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    return rows.join(part, "part").select("user_id", F.when(F.col("part") % 23 != 0, F.col("part")).alias("book_id"), F.concat_ws(" ", "p_name", F.col("part").cast("string")).alias("title"))


def match_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the matching takes them (operators.matching); stores write some fields of a book differently."""
    k, s = F.col("part"), F.col("store_id")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.regexp_replace("p_name", " ", "").alias("name"), F.regexp_replace(F.lower("p_brand"), "#", "").alias("brand"))
    month = F.concat((2000 + k % 20).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"))
    return store_books(spark, sf_dir).join(part, "part").select(
        F.col("store_book_id").alias("id"), "store_id", "part", "book_id", F.concat(F.lpad((k % 997).cast("string"), 3, "0"), "name", F.when((s == 3) & (k % 7 == 0), "s").otherwise("")).alias("title"),
        F.when((s != 1) | (k % 23 != 0), F.concat(F.lit("writer"), (k % 499).cast("string"))).alias("author"),
        F.when((s != 3) | (k % 17 != 0), F.concat("brand", F.when((s == 2) & (k % 31 == 0), "x").otherwise(""))).alias("publisher"),
        F.when((s == 2) & (k % 5 == 0), F.array(F.lit("revised"))).otherwise(F.array().cast("array<string>")).alias("editions"), F.when((s == 1) & (k % 29 == 0), 3).alias("set_volumes"),
        F.when(k % 10 == 0, (k % 7 + F.when((s == 3) & (k % 30 == 0), 2).otherwise(1)).cast("int")).alias("volume"), F.when((s == 3) & (k % 19 == 0), "1999-01").otherwise(month).alias("pub_ym"),
        F.when((k % 3 == 0) & (s != 3), F.concat(F.lit("978"), F.lpad(k.cast("string"), 10, "0"))).alias("isbn13"), "list_price",
    )


#: The same tables in DuckDB's SQL, as leading CTEs of an oracle.
ORACLE = """
books AS (
  SELECT p_partkey AS book_id, p_name || ' ' || p_partkey AS title, 'A' || (p_partkey % 97) AS author, p_brand AS publisher,
         (2000 + p_partkey % 20) || '-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') AS pub_ym FROM part),
store_books AS (
  SELECT s.part * 3 + s.store_id AS store_book_id, s.store_id, s.part, CASE WHEN s.part % 11 <> 0 THEN s.part END AS book_id, p_name || ' ' || s.part AS title,
         CASE WHEN s.part % 13 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN s.part % 7 = 0 AND s.store_id = 2 THEN 500 ELSE 0 END END AS list_price
  FROM (SELECT DISTINCT l_partkey AS part, CAST(l_suppkey % 3 + 1 AS INTEGER) AS store_id FROM lineitem) s JOIN part ON p_partkey = s.part),
lines AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, CAST(l_suppkey % 3 + 1 AS INTEGER) AS store_id, l_partkey AS part,
         sum(CAST(l_quantity AS BIGINT)) AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY ALL),
lists AS (
  SELECT l.*, x.kind, CASE WHEN x.every THEN 'all' ELSE p_type END AS unified, CASE x.kind WHEN 'online' THEN quantity WHEN 'weekly' THEN cents ELSE n END AS sorter
  FROM lines l JOIN part ON p_partkey = l.part
  CROSS JOIN (VALUES ('online', true), ('online', false), ('weekly', true), ('weekly', false), ('offline', true)) x(kind, every)),
rankings AS (
  SELECT snapshot_date, store_id, kind, unified, CAST(row_number() OVER (PARTITION BY snapshot_date, store_id, kind, unified ORDER BY sorter DESC, part) AS INTEGER) AS rank,
         part * 3 + store_id AS store_book_id, part, CASE WHEN store_id <> 1 THEN CAST(quantity AS INTEGER) END AS sales_point FROM lists),
crawl_logs AS (
  SELECT event_id AS log_id, CAST(user_id % 3 + 1 AS INTEGER) AS store_id, CAST(ts AS DATE) AS snapshot_date, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(floor(value) AS INTEGER) AS items, CASE WHEN event_type <> 'signup' THEN ts END AS finished, event_type, user_id FROM events),
match_pairs AS (
  SELECT x.store_book_id AS a, y.store_book_id AS b, x.part, x.part * 3 + x.store_book_id % 3 + y.store_book_id % 3 AS k
  FROM store_books x JOIN store_books y ON x.part = y.part AND x.store_book_id < y.store_book_id),
scored_pairs AS (SELECT *, CAST(60 + k % 41 AS INTEGER) AS score, CASE WHEN 60 + k % 41 >= 85 THEN 'auto_high' WHEN 60 + k % 41 >= 65 THEN 'auto_low' ELSE 'rejected' END AS auto FROM match_pairs),
book_matches AS (
  SELECT a, b, part, score, CASE WHEN k % 17 = 0 THEN 'manual_merge' WHEN k % 19 = 0 THEN 'manual_split' ELSE auto END AS decision, CASE WHEN k % 29 <> 0 THEN auto END AS auto_decision FROM scored_pairs),
favorites AS (
  SELECT f.user_id, CASE WHEN f.part % 23 <> 0 THEN f.part END AS book_id, p_name || ' ' || f.part AS title
  FROM (SELECT DISTINCT o_custkey AS user_id, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey) f JOIN part ON p_partkey = f.part),
match_items AS (
  SELECT store_book_id AS id, store_id, s.part, book_id, lpad(CAST(s.part % 997 AS VARCHAR), 3, '0') || replace(p_name, ' ', '') || CASE WHEN store_id = 3 AND s.part % 7 = 0 THEN 's' ELSE '' END AS title,
         CASE WHEN store_id <> 1 OR s.part % 23 <> 0 THEN 'writer' || (s.part % 499) END AS author,
         CASE WHEN store_id <> 3 OR s.part % 17 <> 0 THEN replace(lower(p_brand), '#', '') || CASE WHEN store_id = 2 AND s.part % 31 = 0 THEN 'x' ELSE '' END END AS publisher,
         CASE WHEN s.part % 3 = 0 AND store_id <> 3 THEN '978' || lpad(CAST(s.part AS VARCHAR), 10, '0') END AS isbn13, list_price
  FROM store_books s JOIN part ON p_partkey = s.part)
"""


def oracle(body: str) -> str:
    """An oracle over the derived tables; body starts with further CTEs (each ending in a comma) or with SELECT."""
    body = body.strip()
    return f"WITH {ORACLE.strip()}{'' if body.upper().startswith('SELECT') else ','}\n{body}"
