"""Price, duplicate, growth, search and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import price as P
from shelfmark.operators import search as S
from shelfmark.plans import adapter as A
from shelfmark.queries.registry import query


@query("""counts AS (SELECT part, list_price, count(list_price) AS n FROM store_books GROUP BY ALL HAVING count(list_price) > 0),
tops AS (SELECT *, n = max(n) OVER (PARTITION BY part) AS top FROM counts),
won AS (SELECT part, CASE WHEN count(*) FILTER (top) = 1 THEN max(list_price) FILTER (top) END AS winner, count(*) > 1 AS split, CAST(sum(n) AS BIGINT) AS known FROM tops GROUP BY part)
SELECT p.part, winner, coalesce(split, false) AS split, coalesce(known, 0) AS known FROM (SELECT DISTINCT part FROM store_books) p LEFT JOIN won USING (part)""")
def price_vote(spark, d):
    return P.vote(A.store_books(spark, d), "part", "list_price")


@query("""known AS (SELECT * FROM store_books WHERE book_id IS NOT NULL AND list_price IS NOT NULL),
prices AS (SELECT book_id, list_price, count(*) AS n FROM known GROUP BY ALL),
total AS (SELECT book_id, sum(n) AS total, count(*) AS prices, max(list_price) - min(list_price) AS gap FROM prices GROUP BY book_id),
detail AS (SELECT book_id, string_agg(store_id || ':' || list_price, ' ' ORDER BY store_id, list_price) AS detail FROM known GROUP BY book_id)
SELECT t.book_id, t.prices, t.gap, (SELECT p.list_price FROM prices p WHERE p.book_id = t.book_id AND p.n * 2 > t.total) AS majority, detail
FROM total t JOIN detail USING (book_id) WHERE prices > 1 ORDER BY gap DESC, book_id LIMIT 25""")
def price_audit(spark, d):
    return P.price_audit(A.store_books(spark, d))


@query("""known AS (SELECT * FROM store_books WHERE book_id IS NOT NULL AND list_price IS NOT NULL),
prices AS (SELECT book_id, list_price, count(*) AS n FROM known GROUP BY ALL), total AS (SELECT book_id, count(*) AS total FROM known GROUP BY book_id HAVING count(*) > 1)
SELECT * FROM total t WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.book_id = t.book_id AND p.n * 2 > t.total)""")
def price_without_majority(spark, d):
    return P.without_majority(A.store_books(spark, d))


@query("SELECT user_id, event_type, count(*) AS n, count(*) - 1 AS surplus FROM crawl_logs GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return P.duplicates(A.crawl_logs(spark, d), ["user_id", "event_type"])


@query("SELECT decision, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent FROM book_matches GROUP BY decision")
def match_distribution(spark, d):
    return P.share_of_total(A.book_matches(spark, d), "decision")


_FIRST = "first AS (SELECT store_book_id, store_id, min(snapshot_date) AS snapshot_date FROM rankings GROUP BY ALL), days AS (SELECT snapshot_date, count(*) FILTER (store_id = 1) AS new_s1, count(*) FILTER (store_id = 2) AS new_s2, count(*) FILTER (store_id = 3) AS new_s3, count(*) AS total FROM first GROUP BY 1)"


@query(f"{_FIRST} SELECT * FROM days")
def growth_by_day(spark, d):
    return P.growth(A.rankings(spark, d), "store_book_id", "snapshot_date")


@query(f"{_FIRST} SELECT count(*) AS days, round(avg(total), 2) AS average, round(avg(total) * 365, 0) AS projected FROM days WHERE snapshot_date > (SELECT min(snapshot_date) FROM days)")
def growth_projection(spark, d):
    return P.projection(P.growth(A.rankings(spark, d), "store_book_id", "snapshot_date"), "snapshot_date")


@query("""own AS (SELECT store_book_id, snapshot_date, rank, sales_point, row_number() OVER w AS k, lag(rank) OVER w AS r0, lag(sales_point) OVER w AS s0 FROM rankings WINDOW w AS (PARTITION BY store_book_id, kind, unified ORDER BY snapshot_date))
SELECT snapshot_date, count(*) FILTER (k = 1) AS first_rows, count(*) FILTER (k > 1 AND rank IS NOT DISTINCT FROM r0 AND sales_point IS NOT DISTINCT FROM s0) AS same_rows, count(*) AS n FROM own GROUP BY 1""")
def unchanged_rows(spark, d):
    out = P.unchanged(A.rankings(spark, d), ["store_book_id", "kind", "unified"], "snapshot_date", ["rank", "sales_point"])
    return out.groupBy("snapshot_date").agg(F.count_if("first").alias("first_rows"), F.count_if("same").alias("same_rows"), F.count("*").alias("n"))


@query("SELECT store_book_id, kind, unified, snapshot_date, rank, sales_point FROM rankings QUALIFY row_number() OVER (PARTITION BY store_book_id, kind, unified ORDER BY snapshot_date DESC) = 1")
def latest_meta(spark, d):
    rows = A.rankings(spark, d).select("store_book_id", "kind", "unified", "snapshot_date", "rank", "sales_point")
    return P.latest(rows, ["store_book_id", "kind", "unified"], [F.desc("snapshot_date")])


@query("""SELECT r.store_book_id, r.sales_point, r.rank FROM rankings r WHERE r.kind = 'online' AND r.unified = 'all' AND r.snapshot_date = DATE '2000-06-01'
AND EXISTS (SELECT 1 FROM rankings o WHERE o.kind = 'online' AND o.unified = 'all' AND o.snapshot_date < DATE '2000-06-01' AND o.store_book_id = r.store_book_id AND o.sales_point IS NOT DISTINCT FROM r.sales_point)""")
def reseen_items(spark, d):
    own = A.rankings(spark, d).where("kind = 'online' AND unified = 'all'")
    old = own.where("snapshot_date < DATE '2000-06-01'").select(F.col("store_book_id").alias("i"), F.col("sales_point").alias("s"))
    new = own.where("snapshot_date = DATE '2000-06-01'")
    return new.join(old, (F.col("store_book_id") == F.col("i")) & F.col("sales_point").eqNullSafe(F.col("s")), "left_semi").select("store_book_id", "sales_point", "rank")


@query("SELECT store_book_id, store_id, book_id FROM store_books s WHERE NOT EXISTS (SELECT 1 FROM rankings r WHERE r.store_book_id = s.store_book_id AND r.snapshot_date >= DATE '2001-01-01')")
def never_ranked(spark, d):
    """Items that stand in no list of the last year, at any rank."""
    return P.never_ranked(A.store_books(spark, d), A.rankings(spark, d).where("snapshot_date >= DATE '2001-01-01'")).select("store_book_id", "store_id", "book_id")


@query("SELECT store_book_id, store_id, book_id FROM store_books s WHERE NOT EXISTS (SELECT 1 FROM rankings r WHERE r.store_book_id = s.store_book_id)")
def never_ranked_whole(spark, d):
    return P.never_ranked(A.store_books(spark, d), A.rankings(spark, d)).select("store_book_id", "store_id", "book_id")


@query("""one AS (SELECT count(*) AS "all", count(*) FILTER (starts_with(decision, 'manual')) AS manual, count(*) FILTER (NOT starts_with(decision, 'manual')) AS automatic, count(*) FILTER (auto_decision IS NULL) AS no_auto,
count(*) FILTER (starts_with(decision, 'manual') AND auto_decision IS NOT NULL) AS overruled, count(*) FILTER (NOT starts_with(decision, 'manual') AND auto_decision <> decision) AS auto_differs FROM book_matches)
SELECT "check", n FROM one UNPIVOT (n FOR "check" IN ("all", manual, automatic, no_auto, overruled, auto_differs))""")
def decision_audit(spark, d):
    return P.decision_audit(A.book_matches(spark, d))


@query("""hit AS (SELECT book_id, title, author, publisher FROM books WHERE title ILIKE '%ring%' OR author ILIKE '%ring%' OR publisher ILIKE '%ring%'),
seen AS (SELECT s.book_id, list_sort(list(DISTINCT r.store_id)) AS stores, max(snapshot_date) AS last_seen, min(rank) AS best FROM rankings r JOIN store_books s USING (store_book_id) WHERE s.book_id IN (SELECT book_id FROM hit) AND kind <> 'offline' GROUP BY 1)
SELECT h.*, array_to_string(stores, ',') AS stores, last_seen, best FROM hit h LEFT JOIN seen USING (book_id) ORDER BY (title ILIKE 'ring%') DESC, last_seen DESC NULLS LAST, best NULLS LAST, book_id LIMIT 100""")
def search_merged(spark, d):
    return S.search_merged("ring", A.books(spark, d), A.rankings(spark, d), A.store_books(spark, d), 100)


@query("SELECT store_book_id, title FROM store_books WHERE title ILIKE '%bolt%' AND store_book_id > 100 ORDER BY store_book_id LIMIT 50")
def search_keyset(spark, d):
    return S.keyset(A.store_books(spark, d).where(S.contains("bolt", "title")), "store_book_id", 100, 50).select("store_book_id", "title")
