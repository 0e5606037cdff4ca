"""History, placement and staleness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import history as H
from shelfmark.plans import adapter as A
from shelfmark.queries.registry import query

IDS = [1, 2, 5, 40, 104, 150]
_HISTORY = f"""
hist AS (
  SELECT s.book_id, r.snapshot_date, r.store_id, CASE WHEN kind = 'weekly' THEN 'weekly' ELSE 'daily' END AS period, r.unified, min(r.rank) AS rank,
         nullif(arg_min(coalesce(r.sales_point, -1), (r.rank, r.kind, r.store_book_id)), -1) AS sales_point
  FROM rankings r JOIN store_books s USING (store_book_id) WHERE s.book_id IN ({', '.join(map(str, IDS))}) GROUP BY ALL)
"""


def _history(spark, d):
    return H.book_history(A.rankings(spark, d), A.store_books(spark, d), IDS)


@query(f"{_HISTORY} SELECT * FROM hist")
def book_history(spark, d):
    return _history(spark, d)


@query(f"""{_HISTORY} SELECT h.*, CAST(row_number() OVER (PARTITION BY book_id ORDER BY store_id, unified <> 'all', period <> 'daily', rank, unified) AS INTEGER) AS place
FROM hist h JOIN (SELECT book_id, max(snapshot_date) AS snapshot_date FROM hist GROUP BY book_id) USING (book_id, snapshot_date)""")
def placements(spark, d):
    return H.placements(_history(spark, d))


@query(f"""{_HISTORY}, own AS (SELECT book_id, period, unified, count(DISTINCT snapshot_date) AS days, min(rank) AS best FROM hist GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY days DESC, best, period, unified) AS INTEGER) AS place FROM own""")
def category_choices(spark, d):
    return H.category_choices(_history(spark, d))


def _delta(value: str, gain: str) -> str:
    return f"""{_HISTORY}, steps AS (SELECT *, lag({value}) OVER (PARTITION BY book_id, store_id, period, unified ORDER BY snapshot_date) AS before FROM hist WHERE {value} IS NOT NULL)
SELECT *, {gain} AS delta, {gain} > 0 AS improved FROM steps WHERE before IS NOT NULL AND before <> {value}"""


@query(_delta("sales_point", "sales_point - before"))
def sparse_delta(spark, d):
    return H.sparse_delta(_history(spark, d), "sales_point", "high")


@query(_delta("rank", "before - rank"))
def sparse_delta_rank(spark, d):
    return H.sparse_delta(_history(spark, d), "rank", "low")


@query(f"{_HISTORY} SELECT *, CAST(dense_rank() OVER (PARTITION BY book_id ORDER BY snapshot_date DESC) AS INTEGER) AS back FROM hist QUALIFY back <= 30")
def trend_series(spark, d):
    return H.trend_series(_history(spark, d))


@query(f"""{_HISTORY} SELECT book_id, greatest(0.0::DOUBLE, min(sales_point) - greatest(CAST(max(sales_point) - min(sales_point) AS DOUBLE), 2000.0::DOUBLE) * 0.15::DOUBLE) AS low,
max(sales_point) + greatest(CAST(max(sales_point) - min(sales_point) AS DOUBLE), 2000.0::DOUBLE) * 0.15::DOUBLE AS high FROM hist WHERE sales_point IS NOT NULL GROUP BY book_id""")
def trend_axis(spark, d):
    return H.axis(_history(spark, d), "sales_point")


@query(f"{_HISTORY} SELECT book_id, snapshot_date, store_id, period, min(rank) AS rank, arg_min(unified, (rank, unified)) AS unified FROM hist WHERE unified <> 'all' GROUP BY ALL")
def top_category_basis(spark, d):
    return H.top_category_basis(_history(spark, d))


@query(f"{_HISTORY} SELECT * FROM hist WHERE sales_point IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, snapshot_date, store_id, period ORDER BY unified) = 1")
def sales_first_seen(spark, d):
    return H.sales_first_seen(_history(spark, d))


@query(f"{_HISTORY} SELECT book_id, snapshot_date, store_id, min(rank) AS rank, arg_min(unified, (rank, unified, period)) AS unified, count(*) - 1 AS others FROM hist GROUP BY ALL")
def best_of_duplicates(spark, d):
    return H.best_of_duplicates(_history(spark, d))


@query("""last AS (SELECT store_id, event_type, max(snapshot_date) AS last_date FROM crawl_logs GROUP BY ALL)
SELECT store_id, event_type, last_date, date_diff('day', last_date, DATE '2024-02-01') AS days,
CASE WHEN days < 2 THEN 'ok' WHEN days < 3 THEN 'warn' ELSE 'bad' END AS state FROM last""")
def staleness(spark, d):
    last = A.crawl_logs(spark, d).groupBy("store_id", "event_type").agg(F.max("snapshot_date").alias("last_date"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), "last_date").cast("long")
    return last.withColumn("days", days).withColumn("state", H.staleness(F.col("days")))


@query("""today AS (SELECT store_book_id, min(rank) AS rank FROM rankings WHERE snapshot_date = DATE '2000-06-01' AND kind = 'online' AND unified = 'all' AND rank <= 100 GROUP BY 1),
grid AS (SELECT b.book_id, x.store_id, x.has FROM books b CROSS JOIN (VALUES (1, true), (2, true), (3, false)) x(store_id, has))
SELECT g.book_id, CAST(g.store_id AS INTEGER) AS store_id, t.rank,
CASE WHEN t.rank IS NOT NULL THEN 'ranked' WHEN NOT has THEN 'unknown' WHEN s.store_book_id IS NOT NULL THEN 'outside' ELSE 'unlinked' END AS status
FROM grid g LEFT JOIN store_books s ON s.book_id = g.book_id AND s.store_id = g.store_id LEFT JOIN today t USING (store_book_id)""")
def rank_status(spark, d):
    return _rank_status(spark, d, A.books(spark, d))


@query("""today AS (SELECT store_book_id, min(rank) AS rank FROM rankings WHERE snapshot_date = DATE '2000-06-01' AND kind = 'online' AND unified = 'all' AND rank <= 100 GROUP BY 1),
grid AS (SELECT b.book_id, x.store_id, x.has FROM books b CROSS JOIN (VALUES (1, true), (2, true), (3, false)) x(store_id, has))
SELECT g.book_id, CAST(g.store_id AS INTEGER) AS store_id, t.rank,
CASE WHEN t.rank IS NOT NULL THEN 'ranked' WHEN NOT has THEN 'unknown' WHEN s.store_book_id IS NOT NULL THEN 'outside' ELSE 'unlinked' END AS status
FROM grid g LEFT JOIN store_books s ON s.book_id = g.book_id AND s.store_id = g.store_id LEFT JOIN today t USING (store_book_id)""")
def rank_status_whole(spark, d):
    return _rank_status(spark, d, A.books(spark, d))


def _rank_status(spark, d, books):
    today = A.rankings(spark, d).where("snapshot_date = DATE '2000-06-01' AND kind = 'online' AND unified = 'all' AND rank <= 100").groupBy("store_book_id").agg(F.min("rank").alias("rank"))
    grid = books.select("book_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("store_id"))
    own = A.store_books(spark, d).select("book_id", "store_id", "store_book_id")
    linked = F.when(F.col("store_id") != 3, F.col("store_book_id").isNotNull())
    return grid.join(own, ["book_id", "store_id"], "left").join(today, "store_book_id", "left").select("book_id", "store_id", "rank", H.rank_status(F.col("rank"), linked).alias("status"))


@query("""SELECT x.book_id AS a, y.book_id AS b, CAST(abs((CAST(x.pub_ym[1:4] AS INTEGER) * 12 + CAST(x.pub_ym[6:7] AS INTEGER)) - (CAST(y.pub_ym[1:4] AS INTEGER) * 12 + CAST(y.pub_ym[6:7] AS INTEGER))) AS INTEGER) AS months
FROM books x JOIN books y ON y.book_id = x.book_id + 7""")
def month_distance(spark, d):
    x = A.books(spark, d).select(F.col("book_id").alias("a"), H.month_index(F.col("pub_ym")).alias("m"))
    y = A.books(spark, d).select((F.col("book_id") - 7).alias("a"), F.col("book_id").alias("b"), H.month_index(F.col("pub_ym")).alias("n"))
    return x.join(y, "a").select("a", "b", F.abs(F.col("m") - F.col("n")).alias("months"))
