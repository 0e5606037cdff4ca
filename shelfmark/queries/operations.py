"""Ingest, lifecycle and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import ingest as I
from shelfmark.operators import lifecycle as L
from shelfmark.operators import review as V
from shelfmark.plans import adapter as A
from shelfmark.queries.registry import query

TODAY = "2024-01-30"


@query(f"""SELECT store_id, snapshot_date, count(*) AS runs, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS bad, CAST(sum(CASE WHEN status = 'success' THEN items ELSE 0 END) AS BIGINT) AS items, max(finished) AS finished, count(*) FILTER (finished IS NULL) AS unfinished
FROM crawl_logs WHERE snapshot_date BETWEEN DATE '{TODAY}' - 14 AND DATE '{TODAY}' GROUP BY ALL""")
def crawl_summary(spark, d):
    return I.crawl_summary(A.crawl_logs(spark, d), TODAY, 14)


@query(f"SELECT log_id, l.store_id, snapshot_date, status, items, CAST(l.store_id <> 1 AS BOOLEAN) AS has_sales FROM crawl_logs l WHERE snapshot_date = DATE '{TODAY}'")
def crawl_detail(spark, d):
    stores = spark.createDataFrame([(1, False), (2, True), (3, True)], "store_id int, has_sales boolean")
    return A.crawl_logs(spark, d).where(F.col("snapshot_date") == F.lit(TODAY).cast("date")).join(F.broadcast(stores), "store_id").select("log_id", "store_id", "snapshot_date", "status", "items", "has_sales")


_BASE = f"""own AS (SELECT store_id, event_type, items, row_number() OVER (PARTITION BY store_id, event_type ORDER BY snapshot_date DESC, log_id DESC) AS k FROM crawl_logs WHERE status = 'success' AND items > 0 AND snapshot_date < DATE '{TODAY}'),
base AS (SELECT store_id, event_type, list_sort(list(items))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS baseline FROM own WHERE k <= 7 GROUP BY ALL)"""


@query(f"{_BASE} SELECT * FROM base")
def baseline_median(spark, d):
    return I.baseline(A.crawl_logs(spark, d), ["store_id", "event_type"], TODAY)


@query(f"""{_BASE} SELECT l.log_id, l.items, b.baseline, CAST(CASE WHEN b.baseline IS NULL THEN 10 ELSE floor(least(b.baseline, 40) * CASE WHEN l.finished IS NOT NULL THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) END AS INTEGER) AS floor
FROM crawl_logs l LEFT JOIN base b USING (store_id, event_type) WHERE snapshot_date = DATE '{TODAY}'""")
def count_floor(spark, d):
    logs = A.crawl_logs(spark, d)
    base = I.baseline(logs, ["store_id", "event_type"], TODAY)
    today = logs.where(F.col("snapshot_date") == F.lit(TODAY).cast("date")).join(base, ["store_id", "event_type"], "left")
    return today.select("log_id", "items", "baseline", I.count_floor(F.col("baseline"), F.lit(40), F.col("finished").isNotNull()).alias("floor"))


@query("""lists_of AS (SELECT snapshot_date, store_id, kind, unified, list_sort(list(DISTINCT part % 40)) AS items FROM rankings GROUP BY ALL)
SELECT snapshot_date, store_id, kind, unified, CAST(len(items) AS BIGINT) AS n, count(*) OVER (PARTITION BY items) AS twins FROM lists_of QUALIFY twins > 1""")
def twin_lists(spark, d):
    """Whole lists of part families that are the same; twin_lists_whole compares the parts themselves."""
    return I.twin_lists(A.rankings(spark, d).withColumn("family", F.col("part") % 40), ["snapshot_date", "store_id", "kind", "unified"], "family")


@query("""lists_of AS (SELECT snapshot_date, store_id, kind, unified, list_sort(list(DISTINCT part)) AS items FROM rankings GROUP BY ALL)
SELECT snapshot_date, store_id, kind, unified, CAST(len(items) AS BIGINT) AS n, count(*) OVER (PARTITION BY items) AS twins FROM lists_of QUALIFY twins > 1""")
def twin_lists_whole(spark, d):
    return I.twin_lists(A.rankings(spark, d), ["snapshot_date", "store_id", "kind", "unified"], "part")


@query("""noisy AS (SELECT snapshot_date, store_id, rank, CASE WHEN rank % 9 = 0 AND store_id = 2 THEN 0 WHEN rank % 50 = 0 THEN 1 ELSE part END AS item, kind, unified FROM rankings),
own AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date, store_id, kind, unified, item ORDER BY rank) AS k FROM noisy),
rated AS (SELECT *, count(*) FILTER (k > 1) OVER (PARTITION BY snapshot_date, store_id, kind, unified) / count(*) OVER (PARTITION BY snapshot_date, store_id, kind, unified) > 0.1 AS failed FROM own)
SELECT snapshot_date, store_id, kind, unified, rank, item, failed FROM rated WHERE k = 1""")
def dedupe_ranks(spark, d):
    item = F.when((F.col("rank") % 9 == 0) & (F.col("store_id") == 2), 0).when(F.col("rank") % 50 == 0, 1).otherwise(F.col("part"))
    keys = ["snapshot_date", "store_id", "kind", "unified"]
    return I.dedupe_ranks(A.rankings(spark, d).select(*keys, "rank", item.alias("item")), keys, "item", "rank")


@query("""pages_of AS (SELECT snapshot_date, store_id, kind, unified, CAST((rank - 1) // 20 + 1 AS INTEGER) AS page, CASE WHEN (rank - 1) // 20 = 2 AND rank % 2 = 0 THEN rank % 20 ELSE part + 1000 END AS item FROM rankings),
firsts AS (SELECT snapshot_date, store_id, kind, unified, item, min(page) AS first_page FROM pages_of GROUP BY ALL)
SELECT snapshot_date, store_id, kind, unified, page, count(*) AS n, count(*) FILTER (first_page < page) AS again FROM (SELECT * FROM pages_of UNION ALL SELECT snapshot_date, store_id, kind, unified, 4, item FROM pages_of WHERE page = 1) JOIN firsts USING (snapshot_date, store_id, kind, unified, item)
GROUP BY ALL HAVING count(*) FILTER (first_page < page) >= count(*) * 0.3""")
def recycled_pages(spark, d):
    page = F.floor((F.col("rank") - 1) / 20).cast("int") + 1
    item = F.when((page == 3) & (F.col("rank") % 2 == 0), F.col("rank") % 20).otherwise(F.col("part") + 1000)
    keys = ["snapshot_date", "store_id", "kind", "unified"]
    rows = A.rankings(spark, d).select(*keys, page.alias("page"), item.alias("item"))
    again = rows.where("page = 1").withColumn("page", F.lit(4))
    return I.recycled_pages(rows.unionByName(again), keys, "page", "item")


@query(f"SELECT store_id FROM (VALUES (1), (2), (3)) s(store_id) WHERE store_id NOT IN (SELECT store_id FROM crawl_logs WHERE snapshot_date = DATE '{TODAY}' AND status = 'success' GROUP BY 1 HAVING sum(items) >= 4300)")
def todo_stores(spark, d):
    return I.todo_stores(A.crawl_logs(spark, d), spark.createDataFrame([(1,), (2,), (3,)], "store_id int"), TODAY, 4300)


@query("""old AS (SELECT part AS k, list_price AS v FROM store_books WHERE store_id = 1), new AS (SELECT part AS k, coalesce(list_price, 0) + 1 AS v FROM store_books WHERE store_id = 2 AND part % 3 = 0)
SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""")
def upsert_items(spark, d):
    items = A.store_books(spark, d)
    old = items.where("store_id = 1").select(F.col("part").alias("k"), F.col("list_price").alias("v"))
    new = items.where("store_id = 2 AND part % 3 = 0").select(F.col("part").alias("k"), (F.coalesce("list_price", F.lit(0)) + 1).alias("v"))
    return I.upsert(old, new, ["k"])


@query("SELECT DISTINCT unified, kind, unified IN ('all', 'PROMO', 'SMALL') AS enabled FROM rankings")
def retired_categories(spark, d):
    rows = A.rankings(spark, d).select("unified", "kind").distinct().withColumn("enabled", F.lit(True))
    return I.retire(rows, spark.createDataFrame([("all",), ("PROMO",), ("SMALL",)], "unified string"), ["unified"])


@query("SELECT store_book_id, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen, count(*) AS n FROM rankings GROUP BY 1")
def last_seen(spark, d):
    return I.last_seen(A.rankings(spark, d), "store_book_id", "snapshot_date")


@query("SELECT snapshot_date, kind, count(*) AS n, min(rank) AS first_rank FROM rankings WHERE rank > CASE kind WHEN 'online' THEN 100 WHEN 'weekly' THEN 150 ELSE 50 END GROUP BY ALL")
def trim_depth(spark, d):
    return L.trim_depth(A.rankings(spark, d), {"online": 100, "weekly": 150}, 50).groupBy("snapshot_date", "kind").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


ALIVE = """recent AS (SELECT DISTINCT store_book_id FROM rankings WHERE snapshot_date >= DATE '2001-11-01'), ranked AS (SELECT DISTINCT store_book_id FROM rankings WHERE rank <= 2 AND kind = 'online'),
alive AS (SELECT store_book_id FROM recent UNION SELECT store_book_id FROM ranked UNION SELECT a FROM book_matches WHERE decision LIKE 'manual%' UNION SELECT b FROM book_matches WHERE decision LIKE 'manual%'),
dormant AS (SELECT s.* FROM store_books s WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.store_book_id = s.store_book_id)
  AND NOT EXISTS (SELECT 1 FROM store_books o JOIN alive a USING (store_book_id) WHERE o.book_id = s.book_id))"""


def dormant(spark, d):
    rankings, items = A.rankings(spark, d), A.store_books(spark, d)
    recent = rankings.where("snapshot_date >= DATE '2001-11-01'")
    ranked = rankings.where("rank <= 2 AND kind = 'online'")
    return L.dormant_items(items, L.alive_items(recent, ranked, A.book_matches(spark, d)))


@query(f"{ALIVE} SELECT store_book_id, store_id, book_id FROM dormant")
def dormant_items(spark, d):
    return dormant(spark, d).select("store_book_id", "store_id", "book_id")


@query(f"{ALIVE} SELECT store_id, count(*) AS items, count(book_id) AS linked, count(DISTINCT book_id) AS books FROM dormant GROUP BY 1")
def dormant_summary(spark, d):
    return dormant(spark, d).groupBy("store_id").agg(F.count("*").alias("items"), F.count("book_id").alias("linked"), F.countDistinct("book_id").alias("books"))


@query("SELECT book_id, title FROM books b WHERE NOT EXISTS (SELECT 1 FROM store_books s WHERE s.book_id = b.book_id)")
def orphan_books(spark, d):
    return L.orphan_books(A.books(spark, d), A.store_books(spark, d)).select("book_id", "title")


@query("SELECT snapshot_date, count(*) AS rows FROM rankings WHERE snapshot_date < DATE '2001-11-04' - 400 GROUP BY 1 ORDER BY 1 LIMIT 14")
def archive_plan(spark, d):
    return L.archive_plan(A.rankings(spark, d), "snapshot_date", "2001-11-04", 90, 400)


_ARCHIVES = "archives AS (SELECT snapshot_date, kind AS table_name, count(*) AS row_count, snapshot_date + 90 AS expires_at, 'run' || (month(snapshot_date) % 4) AS run FROM rankings GROUP BY ALL)"


def _archives(spark, d):
    rows = A.rankings(spark, d).groupBy("snapshot_date", F.col("kind").alias("table_name")).agg(F.count("*").alias("row_count"))
    return rows.withColumn("expires_at", F.date_add("snapshot_date", 90)).withColumn("run", F.concat(F.lit("run"), (F.month("snapshot_date") % 4).cast("string")))


@query(f"""{_ARCHIVES} SELECT min(snapshot_date) AS first_day, max(snapshot_date) AS last_day, count(DISTINCT snapshot_date) AS days, CAST(sum(row_count) AS BIGINT) AS rows,
min(expires_at) FILTER (expires_at > DATE '2001-06-15') AS expires_at, CAST(greatest(0, date_diff('day', DATE '2001-06-15', min(expires_at) FILTER (expires_at > DATE '2001-06-15'))) AS BIGINT) AS days_left FROM archives""")
def archive_range(spark, d):
    return L.archive_range(_archives(spark, d), "2001-06-15")


@query(f"{_ARCHIVES} SELECT expires_at, run, string_agg(DISTINCT CAST(snapshot_date AS VARCHAR), ',') AS dates, count(*) AS files, date_diff('day', DATE '2001-06-15', expires_at) <= 30 AS urgent FROM archives GROUP BY expires_at, run")
def expiry_groups(spark, d):
    return L.expiry_groups(_archives(spark, d), "2001-06-15", 30)


@query("""sizes AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), grown AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS DOUBLE) / 100 AS mb FROM sizes),
ends AS (SELECT (SELECT mb FROM grown ORDER BY day DESC LIMIT 1) AS mb, (SELECT max(day) FROM grown) AS day, (SELECT mb FROM grown WHERE day <= DATE '2024-01-30' - 7 ORDER BY day DESC LIMIT 1) AS mb0, (SELECT max(day) FROM grown WHERE day <= DATE '2024-01-30' - 7) AS day0)
SELECT mb, round((mb - mb0) / date_diff('day', day0, day), 4) AS mb_a_day, CAST(floor((130 - mb) / ((mb - mb0) / date_diff('day', day0, day))) AS BIGINT) AS days_left,
CASE WHEN mb / 130 >= 0.9 THEN 'bad' WHEN mb / 130 >= 0.75 THEN 'warn' WHEN floor((130 - mb) / ((mb - mb0) / date_diff('day', day0, day))) < 30 THEN 'soon' ELSE 'ok' END AS state FROM ends""")
def capacity_projection(spark, d):
    from pyspark.sql import Window as W

    days = A.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    grown = days.select("day", (F.sum("n").over(W.orderBy("day")).cast("double") / 100).alias("mb"))
    return L.capacity(grown, 130.0, TODAY)


@query(f"SELECT status, count(*) AS n, min(snapshot_date) AS oldest FROM crawl_logs WHERE snapshot_date >= DATE '2024-02-20' - 30 GROUP BY 1")
def prune_log(spark, d):
    return L.prune_log(A.crawl_logs(spark, d), "snapshot_date", "2024-02-20", 7).groupBy("status").agg(F.count("*").alias("n"), F.min("snapshot_date").alias("oldest"))


@query("SELECT CAST(least(95, floor(score / 5) * 5) AS INTEGER) AS band, decision, count(*) AS n FROM book_matches GROUP BY ALL")
def score_bands(spark, d):
    return V.score_bands(A.book_matches(spark, d))


@query("SELECT store_book_id, count(*) OVER (PARTITION BY book_id) AS members, CASE WHEN members <= 2 THEN '2' WHEN members = 3 THEN '3' ELSE '4+' END AS size_group FROM store_books WHERE book_id IS NOT NULL")
def group_sizes(spark, d):
    return V.group_sizes(A.store_books(spark, d))


@query("SELECT a, b, score, decision FROM book_matches WHERE decision = 'auto_low' AND score >= 70 ORDER BY score DESC, a, b LIMIT 50 OFFSET 50")
def review_worklist(spark, d):
    return V.worklist(A.book_matches(spark, d), "auto_low", 70, 2, 50).select("a", "b", "score", "decision")


@query("SELECT a, b, score, decision FROM book_matches WHERE a IN (SELECT store_book_id FROM store_books WHERE part % 10 = 3 AND store_id = 2) OR b IN (SELECT store_book_id FROM store_books WHERE part % 10 = 3 AND store_id = 2)")
def matches_touching(spark, d):
    ids = A.store_books(spark, d).where("part % 10 = 3 AND store_id = 2").select(F.col("store_book_id").alias("id"))
    return V.touching(A.book_matches(spark, d).select("a", "b", "score", "decision"), ids)


@query("""clicks AS (SELECT event_id AS seq, (user_id * 3 + 1) AS x, user_id * 3 + 2 + event_id % 2 AS y, CASE event_type WHEN 'click' THEN 'merge' WHEN 'error' THEN 'split' ELSE 'undo' END AS action FROM events),
last AS (SELECT least(x, y) AS a, greatest(x, y) AS b, arg_max(action, (seq, action)) AS action FROM clicks GROUP BY 1, 2)
SELECT coalesce(m.a, l.a) AS a, coalesce(m.b, l.b) AS b, coalesce(score, 0) AS score, CASE action WHEN 'merge' THEN 'manual_merge' WHEN 'split' THEN 'manual_split' WHEN 'undo' THEN auto_decision ELSE m.decision END AS decision, auto_decision
FROM book_matches m FULL JOIN last l ON m.a = l.a AND m.b = l.b WHERE CASE action WHEN 'merge' THEN 'manual_merge' WHEN 'split' THEN 'manual_split' WHEN 'undo' THEN auto_decision ELSE m.decision END IS NOT NULL OR coalesce(score, 0) > 0""")
def decision_merge(spark, d):
    action = F.when(F.col("event_type") == "click", "merge").when(F.col("event_type") == "error", "split").otherwise("undo")
    events = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 3 + 1).alias("a"), (F.col("user_id") * 3 + 2 + F.col("event_id") % 2).alias("b"), action.alias("action"))
    return V.merge_decisions(A.book_matches(spark, d), events)


@query("SELECT x.book_id AS a, y.book_id AS b FROM books x JOIN books y ON x.book_id < y.book_id WHERE x.book_id IN (3, 5, 8, 13, 21, 34) AND y.book_id IN (3, 5, 8, 13, 21, 34)")
def join_pairs(spark, d):
    return V.join_pairs(A.books(spark, d).where(F.col("book_id").isin(3, 5, 8, 13, 21, 34)).select(F.col("book_id").alias("id")))


@query("""src AS (SELECT doc_id AS n, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE CAST(doc_id % 50 AS VARCHAR) END AS raw, CASE doc_id % 4 WHEN 0 THEN 'Merge' WHEN 1 THEN 'split' WHEN 2 THEN '' ELSE 'later' END AS word, lang AS note FROM documents),
rows_of AS (SELECT n, TRY_CAST(raw AS BIGINT) AS id, nullif(lower(word), '') AS decision, note, CASE WHEN TRY_CAST(raw AS BIGINT) IS NULL THEN 'bad_id' WHEN word = '' THEN 'blank' WHEN lower(word) NOT IN ('merge', 'split') THEN 'unknown' ELSE 'ok' END AS bucket FROM src)
SELECT n, id, decision, note, CASE WHEN bucket = 'ok' AND lead(n) OVER (PARTITION BY id, bucket = 'ok' ORDER BY n) IS NOT NULL THEN 'replaced' ELSE bucket END AS bucket FROM rows_of""")
def csv_parse(spark, d):
    word = F.when(F.col("doc_id") % 4 == 0, "Merge").when(F.col("doc_id") % 4 == 1, '"split"').when(F.col("doc_id") % 4 == 2, "").otherwise(" later ")
    number = F.when(F.col("doc_id") % 11 == 0, "x").otherwise((F.col("doc_id") % 50).cast("string"))
    return V.parse_decisions(A.table(spark, d, "documents").select(F.col("doc_id").alias("n"), F.concat_ws(",", number, word, "lang").alias("line")))


@query("""one AS (SELECT title, min(book_id) AS found FROM books GROUP BY title HAVING count(*) = 1),
lost AS (SELECT f.user_id, f.title, o.found FROM favorites f JOIN one o USING (title) WHERE f.book_id IS NULL AND NOT EXISTS (SELECT 1 FROM favorites g WHERE g.user_id = f.user_id AND g.book_id = o.found))
SELECT f.user_id, coalesce(f.book_id, l.found) AS book_id, f.title, f.book_id IS NULL AND l.found IS NOT NULL AS relinked FROM favorites f LEFT JOIN lost l USING (user_id, title)""")
def favorites_relink(spark, d):
    return V.relink_favorites(A.favorites(spark, d), A.books(spark, d))


@query("""per_item AS (SELECT store_book_id, count(*) AS days FROM rankings GROUP BY store_book_id)
SELECT 'books' AS t, count(*) AS n, CAST(0 AS BIGINT) AS emptied FROM books WHERE book_id % 50 <> 0
UNION ALL SELECT 'items', count(*), 0 FROM store_books WHERE book_id IS NULL OR book_id % 50 <> 0
UNION ALL SELECT 'lists', count(*), 0 FROM per_item JOIN store_books USING (store_book_id) WHERE book_id IS NULL OR book_id % 50 <> 0
UNION ALL SELECT 'favorites', count(*), count(*) FILTER (f.book_id % 50 = 0 AND b.book_id IS NOT NULL) FROM favorites f LEFT JOIN books b ON b.book_id = f.book_id""")
def delete_cascade(spark, d):
    """Every fiftieth book goes, its items with it and their lists with these; favorites stay, without a book but with its last title."""
    books = A.books(spark, d).select(F.col("book_id").alias("id"), "title")
    items = A.store_books(spark, d).select(F.col("store_book_id").alias("id"), "book_id")
    lists = A.rankings(spark, d).groupBy("store_book_id").count().select((F.col("store_book_id") + 1_000_000_000).alias("id"), "store_book_id")
    favorites = A.favorites(spark, d).select(F.xxhash64("user_id", "title").alias("id"), "book_id", F.lit(None).cast("string").alias("title"))
    keys = [("items", "book_id", "books", None), ("lists", "store_book_id", "items", None), ("favorites", "book_id", "books", "title")]
    left, _ = L.cascade({"books": books, "items": items, "lists": lists, "favorites": favorites}, keys, "books", books.where("id % 50 = 0"))
    parts = [df.agg(F.count("*").alias("n"), (F.count("title") if t == "favorites" else F.lit(0).cast("long")).alias("emptied")).select(F.lit(t).alias("t"), "n", "emptied") for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""seen AS (SELECT store_book_id, min(snapshot_date) AS first_seen FROM rankings GROUP BY 1), ends AS (SELECT max(snapshot_date) AS today, date_diff('day', min(snapshot_date), max(snapshot_date)) + 1 AS days FROM rankings),
sizes AS (SELECT (SELECT count(*) FROM rankings) * 48 AS daily, (SELECT count(*) FROM crawl_logs) * 96 AS slow, (SELECT count(*) FROM store_books) * 256 + (SELECT count(*) FROM books) * 160 AS catalog, (SELECT count(*) FROM store_books) AS items),
base AS (SELECT (daily + slow + catalog) / 1e6 AS total, daily / 1e6 AS daily, slow / 1e6 AS slow, catalog / 1e6 AS catalog, days, (SELECT count(*) FROM seen, ends WHERE first_seen < today AND first_seen >= today - 900) AS new, catalog / items AS weight FROM sizes, ends),
grown AS (SELECT *, CASE WHEN new > 0 THEN new / 900 * weight / 1e6 END AS growth, daily / days AS per_day FROM base),
far AS (SELECT *, catalog + coalesce(growth, 0) * 365 + per_day * 90 + slow / days * 180 AS steady FROM grown)
SELECT round(total, 6) AS total, round(daily, 6) AS daily, round(slow, 6) AS slow, round(catalog, 6) AS catalog, round(growth, 6) AS growth, round(per_day, 6) AS per_day, round(steady, 6) AS steady,
CAST(CASE WHEN steady <= 1 THEN 999 ELSE floor(greatest(0, 1 - total) / (per_day + slow / days + coalesce(growth, 0))) END AS BIGINT) AS days_left,
CASE WHEN growth IS NULL THEN 'growth unknown' WHEN growth > 0 THEN 'never pruned' WHEN steady > 1 THEN 'over the limit in a year' ELSE 'other' END AS state FROM far""")
def capacity_groups(spark, d):
    """Lists, logs and catalog against a limit of 1 MB, nothing pruning the catalog; lists come by the month, so growth is that of the last 900 days."""
    rows, items = A.rankings(spark, d), A.store_books(spark, d)
    size = lambda df, group, wide, n: df.agg(F.count("*").alias("n")).select(F.lit(group).alias("group"), (F.col("n") * wide).alias("bytes"), (F.col("n") * n).alias("items"))
    sizes = size(rows, "daily", 48, 0).union(size(A.crawl_logs(spark, d), "slow", 96, 0)).union(size(items, "catalog", 256, 1)).union(size(A.books(spark, d), "catalog", 160, 0))
    today = rows.agg(F.max("snapshot_date")).scalar()
    days = rows.agg(F.datediff(F.max("snapshot_date"), F.min("snapshot_date")) + 1).scalar()
    growth = L.growth_a_day(I.last_seen(rows, "store_book_id", "snapshot_date"), today, days, sizes, 900)
    return L.capacity_by_group(sizes, days, growth, 1.0, 90, 180)


@query("""depths AS (SELECT DISTINCT store_id, kind, unified, CAST(5 + length(unified) * store_id AS INTEGER) AS depth FROM rankings WHERE length(unified) % 2 = 1)
SELECT r.* FROM rankings r LEFT JOIN depths d USING (store_id, kind, unified) WHERE rank > coalesce(depth, CASE kind WHEN 'weekly' THEN 30 ELSE 20 END)""")
def trim_by_list(spark, d):
    """What goes if each store's lists of a kind and category have a depth of their own, and those with names of even length their kind's."""
    rows = A.rankings(spark, d)
    depths = rows.where(F.length("unified") % 2 == 1).select("store_id", "kind", "unified").distinct().withColumn("depth", 5 + F.length("unified") * F.col("store_id"))
    return L.trim_by_list(rows, depths, {"weekly": 30}, 20)


_CHOSEN = """chosen AS (SELECT DISTINCT l_orderkey AS request, CASE WHEN l_linenumber = 4 AND l_orderkey % 5 = 0 THEN l_partkey * 3 + 9000000000 ELSE l_partkey * 3 + l_suppkey % 3 + 1 END AS id FROM lineitem),
requests AS (SELECT request, count(*) AS n, CASE WHEN count(*) < 2 THEN 'few' WHEN count(*) > 6 THEN 'many' WHEN count(s.store_book_id) < count(*) THEN 'gone' ELSE 'ok' END AS verdict FROM chosen c LEFT JOIN store_books s ON s.store_book_id = c.id GROUP BY 1)"""


def _chosen(spark, d):
    lines = A.table(spark, d, "lineitem")
    lost = (F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 5 == 0)
    return lines.select(F.col("l_orderkey").alias("request"), F.when(lost, F.col("l_partkey") * 3 + 9_000_000_000).otherwise(F.col("l_partkey") * 3 + F.col("l_suppkey") % 3 + 1).alias("id"))


@query(f"{_CHOSEN} SELECT * FROM requests")
def join_requests(spark, d):
    """The items of an order as one person's request to join them; some name an item that is gone."""
    return V.join_requests(_chosen(spark, d), A.store_books(spark, d))


@query(f"""{_CHOSEN}, pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM chosen x JOIN chosen y ON x.request = y.request AND x.id < y.id JOIN requests r ON r.request = x.request AND verdict = 'ok')
SELECT coalesce(m.a, p.a) AS a, coalesce(m.b, p.b) AS b, coalesce(score, 0) AS score, CASE WHEN p.a IS NOT NULL THEN 'manual_merge' ELSE decision END AS decision, CASE WHEN m.a IS NULL THEN 'rejected' ELSE auto_decision END AS auto_decision
FROM book_matches m FULL JOIN pairs p ON m.a = p.a AND m.b = p.b""")
def forced_joins(spark, d):
    return V.forced_joins(A.book_matches(spark, d), _chosen(spark, d), A.store_books(spark, d))
