"""Ranking and rank-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.operators import ranking as R
from shelfmark.plans import adapter as A
from shelfmark.queries.registry import query

DAY, BEFORE = "2000-06-01", "2000-05-01"


def _listed(day: str, of: str, kind: str, depth: int, unified: str = "all") -> str:
    """CTEs best (book, store) and comb (book) of a list."""
    where = f"AND r.unified = '{unified}'" if unified != "*" else ""
    return f"""
best AS (
  SELECT s.book_id, r.store_id, min(r.rank) AS rank, arg_min(coalesce(r.sales_point, -1), (r.rank, r.unified, r.store_book_id)) AS sales
  FROM rankings r JOIN store_books s USING (store_book_id)
  WHERE r.kind = '{kind}' AND r.snapshot_date = DATE '{day}' AND r.rank <= {depth} AND s.book_id IS NOT NULL {where} GROUP BY ALL),
comb AS (
  SELECT book_id, count(*) AS store_count, round(sum(rank) / count(*), 1) AS avg_rank,
         max(rank) FILTER (store_id = 1) AS rank_s1, max(rank) FILTER (store_id = 2) AS rank_s2, max(rank) FILTER (store_id = 3) AS rank_s3,
         max(nullif(sales, -1)) FILTER (store_id = 1) AS sales_s1, max(nullif(sales, -1)) FILTER (store_id = 2) AS sales_s2, max(nullif(sales, -1)) FILTER (store_id = 3) AS sales_s3
  FROM best GROUP BY book_id)"""


def _tables(spark, d):
    return A.rankings(spark, d), A.store_books(spark, d)


@query(f"{_listed(DAY, 'daily', 'online', 300)} SELECT * FROM comb")
def combined_rows(spark, d):
    return R.by_store(R.combined_rows(R.listed(*_tables(spark, d), DAY)))


@query(f"{_listed(DAY, 'daily', 'online', 300)} SELECT c.*, b.title, b.author, b.publisher, b.pub_ym FROM comb c JOIN books b USING (book_id) WHERE store_count >= 2 ORDER BY avg_rank, store_count DESC, book_id LIMIT 100")
def combined_best(spark, d):
    return R.by_store(R.combined_best(R.listed(*_tables(spark, d), DAY), A.books(spark, d), 2, 100))


@query(f"{_listed(DAY, 'weekly', 'weekly', 500)} SELECT c.*, b.title, b.author, b.publisher, b.pub_ym FROM comb c JOIN books b USING (book_id) ORDER BY avg_rank, store_count DESC, book_id LIMIT 500")
def combined_best_weekly(spark, d):
    return R.by_store(R.combined_best(R.listed(*_tables(spark, d), DAY, "weekly"), A.books(spark, d), 1, 9999))


def _names(name: str, limit: int) -> str:
    return f"""{_listed(DAY, 'daily', 'online', 300)},
own AS (SELECT c.*, b.title, {name} AS name, row_number() OVER (PARTITION BY {name} ORDER BY avg_rank, book_id) AS place FROM comb c JOIN books b USING (book_id))
SELECT name, count(DISTINCT book_id) AS books, min(avg_rank) AS best, CAST(round(sum(greatest(0, CAST(301 - avg_rank AS DECIMAL(18,1))))) AS BIGINT) AS score,
       string_agg(title, ' / ' ORDER BY place) FILTER (place <= 3) AS titles FROM own GROUP BY name ORDER BY score DESC, best, name LIMIT {limit}"""


@query(_names("publisher", 100))
def publisher_ranking(spark, d):
    return R.name_ranking(R.listed(*_tables(spark, d), DAY), A.books(spark, d), R.publisher_name(), 300)


@query(_names("author", 50))
def author_ranking(spark, d):
    return R.name_ranking(R.listed(*_tables(spark, d), DAY), A.books(spark, d), F.trim("author"), 300, 50)


@query(f"{_listed(DAY, 'daily', 'online', 300)} SELECT c.*, b.title FROM comb c JOIN books b USING (book_id) WHERE publisher = 'Brand#2'")
def books_of_publisher(spark, d):
    own = A.books(spark, d).where(R.publisher_name() == "Brand#2").select("book_id", "title")
    return R.by_store(R.combined_rows(R.listed(*_tables(spark, d), DAY)).join(own, "book_id"))


@query(f"""{_listed(DAY, 'daily', 'online', 300)},
top AS (SELECT book_id FROM comb ORDER BY avg_rank, store_count DESC, book_id LIMIT 100)
SELECT unified, count(DISTINCT s.book_id) AS books FROM rankings r JOIN store_books s USING (store_book_id)
WHERE r.kind = 'online' AND r.snapshot_date = DATE '{DAY}' AND r.rank <= 300 AND r.unified <> 'all' AND s.book_id IN (SELECT book_id FROM top) GROUP BY unified""")
def category_share(spark, d):
    return R.category_share(*_tables(spark, d), DAY)


@query("SELECT unified, arg_min(unified || '-' || kind, (length(unified || '-' || kind), unified || '-' || kind)) AS label FROM rankings GROUP BY unified")
def unified_options(spark, d):
    return R.unified_options(A.rankings(spark, d))


@query(f"{_listed(DAY, 'daily', 'online', 300, '*')} SELECT b.*, c.* EXCLUDE (book_id) FROM books b LEFT JOIN comb c USING (book_id) WHERE b.book_id IN (1, 2, 3, 22, 33, 104)")
def books_by_ids(spark, d):
    return R.by_store(R.books_by_ids([1, 2, 3, 22, 33, 104], A.books(spark, d), R.listed(*_tables(spark, d), DAY, unified="*")))


@query("SELECT DISTINCT snapshot_date FROM rankings ORDER BY 1 DESC LIMIT 30")
def snapshot_dates(spark, d):
    return R.snapshot_dates(A.rankings(spark, d))


@query("SELECT DISTINCT unified, snapshot_date FROM rankings WHERE kind = 'online' AND unified IN ('all', 'PROMO') AND snapshot_date >= DATE '2000-01-01'")
def category_dates(spark, d):
    return A.rankings(spark, d).where("kind = 'online' AND unified IN ('all', 'PROMO') AND snapshot_date >= DATE '2000-01-01'").select("unified", "snapshot_date").distinct()


_LISTS = "lists_of AS (SELECT DISTINCT store_id, kind, unified, snapshot_date FROM rankings), prev AS (SELECT *, lag(snapshot_date) OVER (PARTITION BY store_id, kind, unified ORDER BY snapshot_date) AS previous FROM lists_of)"


@query(f"{_LISTS} SELECT * FROM prev")
def previous_date(spark, d):
    return R.previous_dates(A.rankings(spark, d), ["store_id", "kind", "unified"])


@query(f"""{_LISTS}
SELECT r.store_id, r.kind, r.unified, r.store_book_id, r.rank, o.rank AS old_rank, o.rank - r.rank AS change, p.previous IS NOT NULL AND o.rank IS NULL AS is_new
FROM rankings r JOIN prev p USING (store_id, kind, unified, snapshot_date)
LEFT JOIN rankings o ON o.store_id = r.store_id AND o.kind = r.kind AND o.unified = r.unified AND o.snapshot_date = p.previous AND o.store_book_id = r.store_book_id
WHERE r.snapshot_date = DATE '{DAY}'""")
def category_rank_change(spark, d):
    return R.category_rank_change(A.rankings(spark, d), DAY).select("store_id", "kind", "unified", "store_book_id", "rank", "old_rank", "change", "is_new")


def _positions(name: str, day: str, depth: int, limit: int) -> str:
    body = _listed(day, "daily", "online", depth).replace("best AS", f"best_{name} AS").replace("FROM best", f"FROM best_{name}").replace("comb AS", f"comb_{name} AS")
    return f"{body}, {name} AS (SELECT book_id, CAST(row_number() OVER (ORDER BY avg_rank, store_count DESC, book_id) AS INTEGER) AS position FROM comb_{name} QUALIFY position <= {limit})"


@query(f"""{_positions('now', DAY, 300, 100)}, {_positions('old', BEFORE, 300, 100)},
stores_of AS (SELECT (SELECT list_sort(list(DISTINCT store_id)) FROM best_now) = (SELECT list_sort(list(DISTINCT store_id)) FROM best_old) AND (SELECT count(*) FROM old) > 0 AS ok, (SELECT count(*) FROM old) AS n)
SELECT now.book_id, now.position, CASE WHEN ok THEN old.position END AS old_position, CASE WHEN ok THEN old.position - now.position END AS change,
       CASE WHEN ok AND old.position IS NOT NULL THEN false WHEN ok AND n < 100 THEN true END AS is_new
FROM now LEFT JOIN old USING (book_id), stores_of""")
def combined_rank_change(spark, d):
    return R.combined_rank_change(*(R.listed(*_tables(spark, d), day) for day in (DAY, BEFORE)), 1, 100)


@query(f"""{_positions('now', DAY, 300, 100)}, {_positions('old', BEFORE, 300, 100)}
SELECT book_id, now.position, old.position AS old_position, CASE WHEN old.position IS NULL THEN 'new' WHEN old.position - now.position >= 5 THEN 'up' WHEN old.position - now.position <= -5 THEN 'down' END AS mark
FROM now LEFT JOIN old USING (book_id) WHERE mark IS NOT NULL AND (SELECT count(*) FROM old) > 0""")
def report_digest(spark, d):
    return R.report_changes(*_tables(spark, d), DAY, before=BEFORE)


@query(f"""{_positions('now', DAY, 300, 9999999)}, {_positions('old', BEFORE, 300, 9999999)},
scored AS (
  SELECT 'now' AS side, publisher AS name, sum(greatest(0, CAST(301 - avg_rank AS DECIMAL(18,1)))) AS score FROM comb_now JOIN books USING (book_id) GROUP BY publisher
  UNION ALL SELECT 'old', publisher, sum(greatest(0, CAST(301 - avg_rank AS DECIMAL(18,1)))) FROM comb_old JOIN books USING (book_id) GROUP BY publisher),
placed AS (SELECT side, name, CAST(row_number() OVER (PARTITION BY side ORDER BY CAST(round(score) AS BIGINT) DESC, name) AS INTEGER) AS place FROM scored QUALIFY place <= 50)
SELECT n.name, n.place, o.place AS old_place, o.place - n.place AS change FROM placed n LEFT JOIN placed o ON o.name = n.name AND o.side = 'old' WHERE n.side = 'now'""")
def publisher_change(spark, d):
    books, sides = A.books(spark, d), []
    for day in (DAY, BEFORE):
        top = R.name_ranking(R.listed(*_tables(spark, d), day), books, R.publisher_name(), 300, 300)
        place = F.row_number().over(W.orderBy(F.desc("score"), "name"))
        sides.append(top.select("name", place.alias("place")).where("place <= 50"))
    return sides[0].join(sides[1].withColumnRenamed("place", "old_place"), "name", "left").withColumn("change", F.col("old_place") - F.col("place"))


@query("""links(token, target, enabled, expires_at) AS (VALUES ('t1', 'all', true, NULL), ('t2', 'PROMO@2000-06-01', true, TIMESTAMP '2030-01-01'), ('t3', 'SMALL', false, NULL), ('t4', 'LARGE', true, TIMESTAMP '2000-01-01'), ('t5', 'SMALL@soon', true, NULL)),
live AS (SELECT token, split_part(target, '@', 1) AS unified, TRY_CAST(nullif(split_part(target, '@', 2), '') AS DATE) AS asked FROM links WHERE enabled AND (expires_at IS NULL OR expires_at > TIMESTAMP '2001-01-01')),
latest AS (SELECT unified, max(snapshot_date) AS latest FROM rankings WHERE kind = 'online' GROUP BY unified)
SELECT token, snapshot_date, store_id, rank, store_book_id FROM live JOIN latest USING (unified) JOIN rankings r ON r.unified = live.unified AND r.kind = 'online' AND r.snapshot_date = coalesce(asked, latest) AND rank <= 100""")
def share_rankings(spark, d):
    links = spark.createDataFrame([("t1", "all", True, None), ("t2", "PROMO@2000-06-01", True, "2030-01-01"), ("t3", "SMALL", False, None), ("t4", "LARGE", True, "2000-01-01"), ("t5", "SMALL@soon", True, None)], "token string, target string, enabled boolean, expires_at string")
    return R.share_rankings(links.withColumn("expires_at", F.col("expires_at").cast("timestamp")), A.rankings(spark, d), "2001-01-01")
