"""Matching and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import bigrams, jaccard
from shelfmark.operators import clusters as C
from shelfmark.operators import matching as M
from shelfmark.operators import names as N
from shelfmark.plans import adapter as A
from shelfmark.plans.staging import staged
from shelfmark.queries.registry import query

_PAIRS = """keyed AS (SELECT id, unnest(list_filter(['t:' || substr(title, 1, 4), 'a:' || author], lambda x: x IS NOT NULL)) AS key FROM match_items),
sizes AS (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 400),
kept AS (SELECT id, key FROM keyed JOIN sizes USING (key)),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM kept x JOIN kept y ON x.key = y.key AND x.id < y.id)"""
_CLUSTERS = """links AS (SELECT * FROM book_matches WHERE decision IN ('manual_merge', 'auto_high', 'auto_low')),
near AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT store_book_id, store_book_id FROM store_books UNION SELECT r.id, n.y FROM reach r JOIN near n ON r.other = n.x),
members AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"""


def recursive(sql: str) -> str:
    from shelfmark.plans.adapter import oracle

    return oracle(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def _pairs(spark, d):
    return M.block_pairs(A.match_items(spark, d))


def _scored(spark, d):
    items = staged(A.match_items(spark, d), "items")
    return M.scored(M.block_pairs(items), items)


def _links(spark, d):
    return A.book_matches(spark, d).where(F.col("decision").isin("manual_merge", "auto_high", "auto_low"))


def _members(spark, d):
    return C.components(_links(spark, d), A.store_books(spark, d).select(F.col("store_book_id").alias("id")))


def _manual(spark, d):
    return A.book_matches(spark, d).where(F.col("decision").startswith("manual")).select("a", "b", "decision")


@query(_PAIRS + " SELECT a, b FROM pairs")
def block_pairs(spark, d):
    return _pairs(spark, d)


@query(_PAIRS + """, grams AS (SELECT id, list_distinct(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS g FROM match_items),
shared AS (SELECT a, b, len(list_intersect(x.g, y.g)) AS n, len(x.g) AS nx, len(y.g) AS ny FROM pairs JOIN grams x ON x.id = a JOIN grams y ON y.id = b)
SELECT a, b, n / (nx + ny - n) AS overlap FROM shared""")
def bigram_jaccard(spark, d):
    items = A.match_items(spark, d).select("id", bigrams(F.col("title")).alias("g"))
    x, y = items.select(F.col("id").alias("a"), F.col("g").alias("x")), items.select(F.col("id").alias("b"), F.col("g").alias("y"))
    return _pairs(spark, d).join(x, "a").join(y, "b").select("a", "b", jaccard(F.col("x"), F.col("y")).alias("overlap"))


@query()
def match_scores(spark, d):
    return _scored(spark, d)


@query(_PAIRS + " SELECT key, count(*) AS items FROM keyed GROUP BY key HAVING count(*) > 400")
def dropped_blocks(spark, d):
    """Blocks too large to be compared, which the matching leaves out."""
    return M.dropped_blocks(A.match_items(spark, d))


@query()
def reject_reasons(spark, d):
    return M.reject_reasons(_scored(spark, d))


@query(recursive(_CLUSTERS + " SELECT id, root FROM members"), derived=False)
def clusters(spark, d):
    return _members(spark, d)


@query(recursive(_CLUSTERS + """, sized AS (SELECT root, count(*) AS members, count(DISTINCT store_id) AS stores FROM members JOIN match_items USING (id) GROUP BY root),
told AS (SELECT x.root, bool_or(decision = 'manual_merge') AS by_hand, bool_or(decision = 'auto_low') AS weak FROM links JOIN members x ON x.id = a JOIN members y ON y.id = b WHERE x.root = y.root GROUP BY x.root)
SELECT s.root, members, CASE WHEN members = 1 THEN 'single' WHEN coalesce(by_hand, false) THEN 'manual' WHEN stores < members OR coalesce(weak, false) THEN 'low' ELSE 'high' END AS confidence FROM sized s LEFT JOIN told USING (root)"""), derived=False)
def confidence(spark, d):
    return C.confidence(_members(spark, d), _links(spark, d), A.match_items(spark, d))


@query(recursive(_CLUSTERS + """ SELECT root, arg_min(title, (-store_id, id)) AS title, arg_min(author, (-store_id, id)) FILTER (author IS NOT NULL) AS author,
arg_min(publisher, (-store_id, id)) FILTER (publisher IS NOT NULL) AS publisher, arg_min(list_price, (-store_id, id)) FILTER (list_price IS NOT NULL) AS list_price FROM members JOIN match_items USING (id) GROUP BY root"""), derived=False)
def representative(spark, d):
    return C.representative(_members(spark, d), A.match_items(spark, d), ["title", "author", "publisher", "list_price"])


#: Which book an item had: some have that of the next part, so that clusters meet in books.
_KNOWN = "known AS (SELECT id, CASE WHEN id % 4 = 1 THEN book_id + 1 ELSE book_id END AS book_id FROM match_items WHERE book_id IS NOT NULL)"


@query(recursive(_CLUSTERS + f""", {_KNOWN}, roots AS (SELECT DISTINCT root FROM members),
wanted AS (SELECT root, list_sort(list(DISTINCT book_id)) AS books, row_number() OVER (ORDER BY root) AS i FROM members JOIN known USING (id) GROUP BY root),
walk(i, root, pick, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n.i, n.root, list_filter(n.books, lambda x: NOT list_contains(w.taken, x))[1], list_append(w.taken[-40:], list_filter(n.books, lambda x: NOT list_contains(w.taken, x))[1])
  FROM walk w JOIN wanted n ON n.i = w.i + 1)
SELECT r.root, pick AS book_id FROM roots r LEFT JOIN walk USING (root)"""), derived=False)
def master_keys(spark, d):
    """In order of the roots, each cluster takes the least book that none before it took. Books that far apart clusters
    share there are none here, so the SQL remembers the last 40 that were taken."""
    book = F.when(F.col("id") % 4 == 1, F.col("book_id") + 1).otherwise(F.col("book_id"))
    return C.master_keys(_members(spark, d), A.match_items(spark, d).select("id", book.alias("book_id")))


def _told_items(spark, d):
    """Items with publishers of which some contradict, some are spelt in brackets."""
    k, s, p = F.col("part"), F.col("store_id"), F.col("publisher")
    name = F.when((s == 3) & (k % 13 == 0), F.reverse(p)).when((s == 2) & (k % 13 == 0) & (k % 2 == 0), F.concat(F.reverse(p), F.lit("("), p, F.lit(")"))).otherwise(p)
    return A.match_items(spark, d).withColumn("publisher", name)


@query(recursive(_CLUSTERS + """, told AS (SELECT id, publisher, CASE WHEN store_id = 3 AND part % 13 = 0 THEN reverse(publisher) WHEN store_id = 2 AND part % 13 = 0 AND part % 2 = 0 THEN reverse(publisher) || '(' || publisher || ')' ELSE publisher END AS name,
store_id = 3 AND part % 13 = 0 AS turned, store_id = 2 AND part % 13 = 0 AND part % 2 = 0 AS bridge FROM match_items WHERE publisher IS NOT NULL),
own AS (SELECT m.root, t.* FROM members m JOIN told t USING (id)),
by_hand AS (SELECT DISTINCT x.root FROM links l JOIN own x ON x.id = l.a JOIN own y ON y.id = l.b WHERE decision = 'manual_merge' AND x.root = y.root AND x.turned <> y.turned)
SELECT root, array_to_string(list_sort(list(DISTINCT name)), ',') AS publishers, CAST(2 AS BIGINT) AS n FROM own GROUP BY root
HAVING bool_or(turned) AND NOT bool_and(turned) AND NOT bool_or(bridge) AND root NOT IN (SELECT root FROM by_hand)"""), derived=False)
def publisher_conflicts(spark, d):
    """A name and the same backwards are two sides, unless a third tells both, or a person joined them."""
    return C.publisher_conflicts(_members(spark, d), _told_items(spark, d), _manual(spark, d))


@query(recursive(_CLUSTERS + """, told AS (SELECT id, CASE WHEN publisher IS NULL THEN NULL ELSE store_id = 3 AND part % 13 = 0 END AS side FROM match_items),
own AS (SELECT m.id, m.root, t.side FROM members m JOIN told t USING (id)),
several AS (SELECT root FROM own GROUP BY root HAVING count(DISTINCT side) > 1),
first_of AS (SELECT root, side, min(id) AS part FROM own WHERE side IS NOT NULL GROUP BY ALL),
both_ends AS (SELECT a AS id, b AS other, score FROM links UNION ALL SELECT b, a, score FROM links),
led AS (SELECT o.id, arg_max(f.part, (e.score, -e.other)) AS part FROM own o JOIN both_ends e USING (id) JOIN own p ON p.id = e.other AND p.root = o.root AND p.side IS NOT NULL JOIN first_of f ON f.root = p.root AND f.side = p.side WHERE o.side IS NULL GROUP BY o.id),
parts AS (SELECT o.id, CASE WHEN o.root NOT IN (SELECT root FROM several) THEN o.root WHEN o.side IS NOT NULL THEN f.part ELSE coalesce(l.part, o.id) END AS part FROM own o LEFT JOIN first_of f ON f.root = o.root AND f.side = o.side LEFT JOIN led l ON l.id = o.id)
SELECT id, min(id) OVER (PARTITION BY part) AS root FROM parts"""), derived=False)
def split_by_publisher(spark, d):
    """Clusters split by sides of publishers; items without one go with their best link."""
    k, s = F.col("part"), F.col("store_id")
    items = A.match_items(spark, d).withColumn("publisher", F.when((s == 3) & (k % 13 == 0), F.reverse("publisher")).otherwise(F.col("publisher")))
    members = _members(spark, d)
    own = members.join(items.select("id", "publisher"), "id")
    by_name = own.join(N.sides(own, "root", "publisher"), ["root", "publisher"]).select("id", "side")
    return C.split_by_sides(members, by_name, _links(spark, d))


@query(recursive(_CLUSTERS + " SELECT l.a, l.b, l.score, l.decision FROM links l JOIN members x ON x.id = l.a JOIN members y ON y.id = l.b WHERE x.root = y.root"), derived=False)
def kept_links(spark, d):
    return C.kept_links(_links(spark, d).select("a", "b", "score", "decision"), _members(spark, d))


_SPELT = """raw AS (SELECT CASE store_id WHEN 1 THEN lower(p.brand) WHEN 2 THEN CASE WHEN part % 2 = 0 THEN lower(p.brand) || '(h' || substr(p.brand, 7) || ')' ELSE lower(p.brand) || '(reprint)' END ELSE CASE WHEN part % 4 = 0 THEN 'h' || substr(p.brand, 7) ELSE lower(p.brand) END END AS k,
CASE WHEN store_id = 3 AND part % 8 = 0 THEN upper(p.brand) WHEN store_id = 2 THEN p.brand || ' (h)' ELSE p.brand END AS raw FROM match_items m JOIN (SELECT p_partkey AS b, p_brand AS brand FROM part) p ON p.b = m.part)"""


@query(_SPELT.replace("raw AS", "raw AS", 1) + """,
forms AS (SELECT k, raw, count(*) AS n FROM raw GROUP BY ALL), keys AS (SELECT DISTINCT k FROM forms),
houses AS (SELECT k, CASE WHEN k LIKE 'h%' THEN 'brand#' || substr(k, 2) WHEN contains(k, '(') THEN split_part(k, '(', 1) ELSE k END AS house FROM keys),
used AS (SELECT house, raw, sum(n) AS n FROM forms JOIN houses USING (k) GROUP BY ALL),
shown AS (SELECT house, arg_min(raw, (contains(raw, '('), -n, length(raw), raw)) AS display, count(*) AS spellings FROM used GROUP BY house)
SELECT k, CASE WHEN house = 'brand#1' THEN 'House One' ELSE display END AS display, spellings FROM houses JOIN shown USING (house)""")
def canonical_names(spark, d):
    """Publishers under several spellings, some of which tell others in brackets, and one that a person named."""
    k, s, p = F.col("part"), F.col("store_id"), F.col("p_brand")
    low, short = F.lower(p), F.concat(F.lit("h"), F.substring(p, 7, 100))
    key = F.when(s == 1, low).when((s == 2) & (k % 2 == 0), F.concat(low, F.lit("("), short, F.lit(")"))).when(s == 2, F.concat(low, F.lit("(reprint)"))).when(k % 4 == 0, short).otherwise(low)
    raw = F.when((s == 3) & (k % 8 == 0), F.upper(p)).when(s == 2, F.concat(p, F.lit(" (h)"))).otherwise(p)
    brands = A.table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    rows = A.match_items(spark, d).select("part", "store_id").join(brands, "part")
    hand = spark.createDataFrame([("brand#1", "House One")], "spelling string, name string")
    return N.canonical_names(rows.select(key.alias("k"), raw.alias("r")), "k", "r", hand, categories=("reprint",))


@query("""wide AS (SELECT id, title, isbn13, list_distinct(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS g, 'crew' || (part // 180) AS author FROM match_items),
keyed AS (SELECT id, unnest(['t:' || substr(title, 1, 4), 'a:' || author]) AS key FROM wide),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.key = y.key AND x.id < y.id)
SELECT a, b FROM pairs JOIN wide x ON x.id = a JOIN wide y ON y.id = b
WHERE 5 * len(list_intersect(x.g, y.g)) >= len(list_distinct(x.g || y.g)) OR starts_with(x.title, y.title) OR starts_with(y.title, x.title) OR x.isbn13 = y.isbn13""")
def exact_blocks(spark, d):
    """Pairs of blocks of any size, here of up to 540 items an author: all that the gates on titles leave open."""
    crew = F.concat(F.lit("crew"), F.floor(F.col("part") / 180).cast("string"))
    return M.block_pairs(A.match_items(spark, d).withColumn("author", crew), most=None)


_MIXED = """mixed AS (SELECT id, CASE WHEN part % 4 = 0 THEN 2 ELSE store_id END AS store_id FROM match_items)"""


@query(recursive(_CLUSTERS + f""", {_MIXED}, own AS (SELECT m.id, m.root, x.store_id FROM members m JOIN mixed x USING (id)),
ends AS (SELECT a AS id, b AS other, score, decision FROM links UNION ALL SELECT b, a, score, decision FROM links),
told AS (SELECT o.id, sum(CASE WHEN p.store_id <> o.store_id THEN e.score ELSE 0 END) AS weight, bool_or(e.decision = 'manual_merge') AS by_hand FROM ends e JOIN own o ON o.id = e.id JOIN own p ON p.id = e.other AND p.root = o.root GROUP BY o.id),
ranked AS (SELECT o.*, coalesce(by_hand, false) AS by_hand, row_number() OVER (PARTITION BY root, store_id ORDER BY coalesce(weight, 0) DESC, id) AS k, coalesce(bool_or(by_hand) OVER (PARTITION BY root, store_id), false) AS some_hand FROM own o LEFT JOIN told USING (id)),
stay AS (SELECT *, CASE WHEN some_hand THEN by_hand ELSE k = 1 END AS kept FROM ranked)
SELECT id, CASE WHEN kept THEN min(id) FILTER (kept) OVER (PARTITION BY root) ELSE id END AS root FROM stay"""), derived=False)
def one_per_store(spark, d):
    """One item of each store in a cluster, or those that a person joined; every fourth book has its items in one store."""
    items = A.match_items(spark, d).select("id", F.when(F.col("part") % 4 == 0, 2).otherwise(F.col("store_id")).alias("store_id"))
    return C.one_per_store(_members(spark, d), _links(spark, d), items)


_FILL = """couples AS (SELECT part, min(id) AS root, min(id) AS x, max(id) AS y FROM match_items WHERE store_id <> 3 GROUP BY part HAVING count(*) = 2),
singles AS (SELECT id, part FROM match_items WHERE store_id = 3),
members AS (SELECT m.id, coalesce(c.root, m.id) AS root FROM match_items m LEFT JOIN couples c ON c.part = m.part AND m.store_id <> 3),
pairs AS (SELECT e.a, s.id AS b, 60 + (c.part * 7 + s.part * 11 + e.a * 5) % 41 AS score, (c.part + s.part) % 5 = 0 AS refused, (c.part * 3 + s.part) % 13 = 0 AS split, c.root
 FROM couples c JOIN singles s ON s.part BETWEEN c.part - 3 AND c.part + 3 CROSS JOIN LATERAL (SELECT unnest([c.x, c.y]) AS a) e),
asked AS (SELECT root, b, min(score) AS weaker FROM pairs WHERE score >= 70 AND NOT refused AND NOT split GROUP BY root, b HAVING count(*) = 2),
wanted AS (SELECT root, list(b ORDER BY weaker DESC, b) AS wish, row_number() OVER (ORDER BY root) AS i FROM asked GROUP BY root)"""


@query(recursive(_FILL + """,
walk(i, root, pick, taken) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT n.i, n.root, list_filter(n.wish, lambda x: NOT list_contains(w.taken, x))[1], list_append(w.taken[-40:], list_filter(n.wish, lambda x: NOT list_contains(w.taken, x))[1])
  FROM walk w JOIN wanted n ON n.i = w.i + 1),
joined AS (SELECT m.id, coalesce(w.root, m.root) AS part FROM members m LEFT JOIN walk w ON w.pick = m.id)
SELECT id, min(id) OVER (PARTITION BY part) AS root FROM joined"""), derived=False)
def fill_missing(spark, d):
    """Couples of two stores take an item of the third in order, out of those of neighbouring books, which several of them want."""
    items = staged(A.match_items(spark, d).select("id", "store_id", "part"), "items")
    couples = items.where("store_id <> 3").groupBy("part").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("n = 2")
    members = items.join(couples.select("part", "x"), "part", "left").select("id", F.when(F.col("store_id") != 3, F.coalesce("x", "id")).otherwise(F.col("id")).alias("root"))
    near = couples.select(F.col("part").alias("p"), F.explode(F.array("x", "y")).alias("a")).withColumn("part", F.explode(F.sequence(F.col("p") - 3, F.col("p") + 3)))
    pairs = near.join(items.where("store_id = 3").select("part", F.col("id").alias("b")), "part")
    pairs = pairs.select("a", "b", (60 + (F.col("p") * 7 + F.col("part") * 11 + F.col("a") * 5) % 41).alias("score"), F.when((F.col("p") + F.col("part")) % 5 == 0, "rejected").otherwise("auto_low").alias("decision"), ((F.col("p") * 3 + F.col("part")) % 13 == 0).alias("split"))
    return C.fill_missing(members, pairs, items, pairs.where("split").select("b", "a", F.lit("manual_split").alias("decision")))


@query()
def cluster_repair(spark, d):
    """The whole of the matching: pairs, scores, decisions by hand, components, repair, one item a store, missing stores."""
    items = staged(A.match_items(spark, d), "items")
    pairs = staged(M.scored(M.block_pairs(items), items), "scored")
    manual = _manual(spark, d)
    links = staged(M.with_decisions(pairs, manual), "links")
    members = staged(C.one_per_store(C.repair(C.components(links, items), links, manual, items), links, items), "members")
    return M.filled(members, items, manual)
