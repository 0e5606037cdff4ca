"""Normalisation and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.plans import adapter as A
from shelfmark.queries.registry import query
from shelfmark.sources import boxes as B
from shelfmark.sources import html as H
from shelfmark.sources import robots as R

_TITLE = """titles AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN p_name || ' (Revised Edition)' WHEN 1 THEN 'NEW! ' || p_name || ' [Deluxe] - A Guide' WHEN 2 THEN p_name || ': Vol. ' || p_partkey % 300
 WHEN 3 THEN p_name || ' ' || p_partkey % 90 || ' (all 5 vols)' WHEN 4 THEN 'hot Best ' || p_name || p_partkey % 50 WHEN 5 THEN 'limited ' || p_name || ' set of 3' WHEN 6 THEN 'Unlimited ' || p_name || ' Deluxe Box' ELSE p_name || ' deluxe deluxe box, fully revised {special}' END AS t FROM part)"""


def _titles(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    s = lambda x: x.cast("string")
    t = (F.when(k % 8 == 0, F.concat(name, F.lit(" (Revised Edition)"))).when(k % 8 == 1, F.concat(F.lit("NEW! "), name, F.lit(" [Deluxe] - A Guide"))).when(k % 8 == 2, F.concat(name, F.lit(": Vol. "), s(k % 300)))
         .when(k % 8 == 3, F.concat(name, F.lit(" "), s(k % 90), F.lit(" (all 5 vols)"))).when(k % 8 == 4, F.concat(F.lit("hot Best "), name, s(k % 50))).when(k % 8 == 5, F.concat(F.lit("limited "), name, F.lit(" set of 3")))
         .when(k % 8 == 6, F.concat(F.lit("Unlimited "), name, F.lit(" Deluxe Box"))).otherwise(F.concat(name, F.lit(" deluxe deluxe box, fully revised {special}"))))
    return A.table(spark, d, "part").select(k.alias("k"), t.alias("t"))


@query(_TITLE + r""",
whole AS (SELECT k, regexp_replace(regexp_replace(regexp_replace(trim(t), '^(?i:new|hot|best|sale)!?\s+', ''), '^(?i:new|hot|best|sale)!?\s+', ''), '^(?i:new|hot|best|sale)!?\s+', '') AS t FROM titles),
bare AS (SELECT k, t, trim(regexp_replace(t, '\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}', ' ', 'g')) AS b FROM whole),
cores AS (SELECT k, t, b, regexp_replace(lower(trim(regexp_replace(b, '^(.{2,}?)(?: - |: ).*$', '\1'))), '\b(?:fully revised|illustrated|deluxe box|expanded|edition|limited|revised|special|deluxe)\b', ' ', 'g') AS c FROM bare)
SELECT k, nullif(regexp_replace(regexp_replace(c, '\ball \d+ vols?\b|\bset( of \d+)?\b', ' ', 'g'), '[^\p{L}\p{N}]+', '', 'g'), '') AS core,
nullif(lower(regexp_replace(trim(regexp_extract(b, '^.{2,}?(?: - |: )(.*)$', 1)), '[^\p{L}\p{N}]+', '', 'g')), '') AS subtitle,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(t), '\b(?:fully revised|illustrated|deluxe box|expanded|limited|revised|special|deluxe)\b'), lambda w: CASE w WHEN 'deluxe box' THEN 'boxed' WHEN 'fully revised' THEN 'revised' ELSE w END)
|| CASE WHEN regexp_matches(lower(t), '\ball \d+ vols?\b') THEN ['all volumes'] ELSE [] END || CASE WHEN regexp_matches(lower(t), '\bset\b') THEN ['set'] ELSE [] END)), ',') AS editions,
TRY_CAST(nullif(regexp_extract(lower(t), '(?:all|set of) (\d+)', 1), '') AS INTEGER) AS set_volumes FROM cores""")
def normalize_title(spark, d):
    return _titles(spark, d).select("k", T.normalize_title(F.col("t")).alias("r")).select("k", "r.core", "r.subtitle", F.array_join("r.editions", ",").alias("editions"), "r.set_volumes")


@query(_TITLE + r""", low AS (SELECT k, regexp_replace(lower(t), '(?:all|set of) \d+(?: vols)?', ' ', 'g') AS t FROM titles),
found AS (SELECT k, CAST(coalesce(nullif(regexp_extract(t, '\b(?:vol|volume|no)\.? ?(\d{1,3})\b', 1), ''), nullif(regexp_extract(t, '\S\s+(\d{1,3})(?:\s|$)', 1), ''), nullif(regexp_extract(t, '\pL(\d{1,3})$', 1), '')) AS INTEGER) AS v FROM low)
SELECT k, CASE WHEN v BETWEEN 1 AND 200 THEN v END AS volume FROM found""")
def volume_number(spark, d):
    return _titles(spark, d).select("k", T.volume_number(F.col("t")).alias("volume"))


@query(r"""raw AS (SELECT p_partkey AS k, p_brand || CASE p_partkey % 3 WHEN 0 THEN ' Press Inc.' WHEN 1 THEN ' (Seoul) Books' ELSE ' Publishing' END AS p, 'By A' || p_partkey % 97 || CASE WHEN p_partkey % 2 = 0 THEN ' (editor)' ELSE ' Author' END AS a FROM part)
SELECT k, nullif(regexp_replace(regexp_replace(lower(p), '\b(?:publishing|publishers|press|books|inc|ltd)\b\.?', ' ', 'g'), '[^\p{L}\p{N}()]+', '', 'g'), '') AS publisher,
nullif(lower(regexp_replace(regexp_replace(lower(trim(regexp_replace(a, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'))), '\b(?:author|editor|translator|by)\b', ' ', 'g'), '[^\p{L}\p{N}]+', '', 'g')), '') AS author FROM raw""")
def normalize_names(spark, d):
    k = F.col("p_partkey")
    p = F.concat("p_brand", F.when(k % 3 == 0, " Press Inc.").when(k % 3 == 1, " (Seoul) Books").otherwise(" Publishing"))
    a = F.concat(F.lit("By A"), (k % 97).cast("string"), F.when(k % 2 == 0, " (editor)").otherwise(" Author"))
    return A.table(spark, d, "part").select(k.alias("k"), T.normalize_publisher(p).alias("publisher"), T.normalize_author(a).alias("author"))


@query("""base AS (SELECT p_partkey AS k, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS f FROM part),
sums AS (SELECT k, f, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(f[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS INTEGER) AS c FROM base)
SELECT k, CASE WHEN k % 5 = 0 THEN f || (c + 1) % 10 ELSE f || c END AS isbn, k % 5 <> 0 AS valid FROM sums""")
def isbn_check(spark, d):
    k = F.col("p_partkey")
    first = F.concat(F.lit("978"), F.lpad((k * 7919 % 1_000_000_000).cast("string"), 9, "0"))
    rows = A.table(spark, d, "part").select(k.alias("k"), F.concat(first, ((T.isbn13_digit(first) + F.when(k % 5 == 0, 1).otherwise(0)) % 10).cast("string")).alias("isbn"))
    return rows.withColumn("valid", T.is_isbn13(F.col("isbn")))


@query("""raw AS (SELECT event_id AS k, CAST(floor(value * 1000) AS BIGINT) AS v FROM events)
SELECT k, CASE WHEN k % 4 = 0 THEN CASE WHEN v BETWEEN 1000 AND 2000000 THEN v END ELSE CASE WHEN v BETWEEN 1000 AND 2000000 THEN greatest(v, 15000) ELSE 15000 END END AS list_price,
CASE WHEN k % 4 <> 0 AND v BETWEEN 1000 AND 2000000 THEN least(v, 15000) END AS sale_price FROM raw""")
def price_parse(spark, d):
    v = F.floor(F.col("value") * 1000).cast("long")
    text = F.concat(F.lit("Now "), v.cast("string"), F.lit(" won, was 15,000 won"), F.when(F.col("event_id") % 4 == 0, " or more").otherwise(" each"))
    return A.table(spark, d, "events").select(F.col("event_id").alias("k"), T.parse_prices(text).alias("r")).select("k", "r.*")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links,
CAST(length(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g')) AS BIGINT) AS text_chars FROM pages""", derived=False)
def html_extract(spark, d):
    return H.summary(A.table(spark, d, "pages"))


@query("""SELECT page_id, CAST(page_id * 20 + i AS BIGINT) AS rank, items[i] AS item FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"]*)">', 1) AS items FROM pages))""", derived=False)
def html_listing(spark, d):
    return H.listing(A.table(spark, d, "pages"))


@query("SELECT page_id, CASE WHEN coalesce(length(html), 0) < 200 THEN 'short' WHEN contains(lower(html), 'captcha') OR contains(lower(html), 'access denied') OR contains(lower(html), 'unusual traffic') THEN 'blocked' WHEN NOT contains(html, '<article>') THEN 'no_article' ELSE 'ok' END AS state FROM pages", derived=False)
def page_diagnosis(spark, d):
    return H.diagnosis(A.table(spark, d, "pages"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]*(/[^#]*)', 1) AS path FROM pages),
rules(pattern, regex, allow) AS (VALUES ('/en/', '^/en/', false), ('/en/*.html', '^/en/.*\.html', true), ('/fr/*?page', '^/fr/.*\?page', false), ('/de/$', '^/de/$', false), ('/', '^/', true)),
best AS (SELECT page_id, max((length(pattern), allow)) AS m FROM p LEFT JOIN rules ON regexp_matches(path, regex) GROUP BY page_id)
SELECT page_id, coalesce(m[2], true) AS allowed FROM best""", derived=False)
def robots_rules(spark, d):
    rules = spark.createDataFrame([("/en/", False), ("/en/*.html", True), ("/fr/*?page", False), ("/de/$", False), ("/", True)], "pattern string, allow boolean")
    return H.robots(A.table(spark, d, "pages"), rules)


#: A host's robots text, of three kinds by the length of its name.
_ROBOTS = [
    "User-agent: *\nDisallow: /es/ # closed\n\nUser-agent: shelf\nUSER-AGENT: reader\nDisallow: /en/\nAllow: /en/*.html$\nnoise\n",
    "Disallow:\nDisallow: /d%65/\nAllow: /d%65/\n", "User-agent: shelfmark\r\nDisallow: /*?\n", "Allow: /en/\nSitemap: http://map\nDisallow: /fr/1"]
_ROBOTS_SQL = " || ".join(["'# ' || host || chr(10)", "replace(replace('" + _ROBOTS[0].replace("\n", "~").replace("\r", "^") + "' || CASE length(host) % 3 " + " ".join(f"{when} '{t.replace(chr(10), '~').replace(chr(13), '^')}'" for when, t in zip(("WHEN 0 THEN", "WHEN 1 THEN", "ELSE"), _ROBOTS[1:], strict=True)) + " END, '~', chr(10)), '^', chr(13))"])


@query(rf"""WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
texts AS (SELECT host, string_split_regex({_ROBOTS_SQL}, '\r\n|\r|\n') AS lines FROM hosts),
bare AS (SELECT host, unnest(range(1, len(lines) + 1)) AS pos, regexp_replace(unnest(lines), '#.*$', '') AS l FROM texts),
told AS (SELECT host, pos, lower(trim(split_part(l, ':', 1))) AS key, trim(substr(l, strpos(l, ':') + 1)) AS value FROM bare WHERE contains(l, ':')),
before AS (SELECT *, key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY host ORDER BY pos), '') <> 'user-agent' AS opens FROM told),
grouped AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY host ORDER BY pos) AS grp FROM before),
chosen AS (SELECT host, arg_max(grp, (CASE WHEN value = '*' THEN 0 ELSE length(value) END, -pos)) AS grp FROM grouped WHERE key = 'user-agent' AND (value = '*' OR contains('shelfmark/2.0', lower(value))) GROUP BY host),
rules AS (SELECT host, value, key = 'allow' AS allow, replace(value, '%65', 'e') AS text FROM grouped JOIN chosen USING (host, grp) WHERE key IN ('allow', 'disallow') AND value <> ''),
tests AS (SELECT *, '^' || replace(replace(replace(replace(regexp_replace(text, '\$$', ''), '?', '[?]'), '.', '[.]'), '*', '.*'), '%', '[%]') || CASE WHEN ends_with(text, '$') THEN '$' ELSE '' END AS test FROM rules),
asked AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
best AS (SELECT page_id, arg_max(value, (length(value), allow)) AS rule, arg_max(allow, (length(value), allow)) AS allow FROM asked a LEFT JOIN tests t ON t.host = a.host AND regexp_matches(path, test) GROUP BY page_id)
SELECT page_id, coalesce(allow, true) AS allowed, rule FROM best""", derived=False)
def robots_texts(spark, d):
    """From each host's robots text to a verdict on each of its pages, for one agent."""
    pages = A.table(spark, d, "pages")
    n = F.length("host") % 3
    kind = F.when(n == 0, _ROBOTS[1]).when(n == 1, _ROBOTS[2]).otherwise(_ROBOTS[3])
    texts = pages.select(R.host_of(F.col("url")).alias("host")).distinct().select("host", F.concat(F.lit("# "), "host", F.lit("\n" + _ROBOTS[0]), kind).alias("text"))
    return R.verdicts(pages, R.rules_for(texts, "Shelfmark/2.0"))


@query(r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, regexp_extract(items[i], 'href="([^"]*)"', 1) AS link, trim(regexp_replace(items[i], '<[^>]*>', '', 'g')) AS text
FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages))""", derived=False)
def page_boxes(spark, d):
    """Every list entry of the pages, by the nesting of tags."""
    rows = B.boxes(A.table(spark, d, "pages"), name="")
    return rows.select("page_id", "place", F.get("links", F.lit(0)).alias("link"), "text")


@query(r"""WITH nine AS (SELECT page_id, html, lpad(CAST(page_id * 7919 % 1000000000 AS VARCHAR), 9, '0') AS n FROM pages),
digits AS (SELECT *, (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(n[i] AS INTEGER) * (11 - i))) % 11) % 11 AS c10, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(('978' || n)[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS c13 FROM nine),
numbers AS (SELECT *, n || CASE WHEN c10 = 10 THEN 'X' ELSE CAST(CAST(c10 AS INTEGER) AS VARCHAR) END AS ten, '978' || n || CAST(c13 AS INTEGER) AS long, '978' || n || CAST((c13 + 1) % 10 AS INTEGER) AS wrong FROM digits),
runs AS (SELECT page_id, unnest(regexp_extract_all('<p id="' || long || '">' || html || ' ' || ten || ', not ' || wrong || ' or ' || long || '-2', '[0-9-]*[0-9][0-9-]*[Xx]?')) AS r FROM numbers),
checked AS (SELECT page_id, CASE
  WHEN regexp_matches(r, '^[0-9]{13}$') AND (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(r[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(r[13] AS INTEGER) THEN r
  WHEN regexp_matches(r, '^[0-9]{9}[0-9Xx]$') AND (list_sum(list_transform(range(1, 10), lambda i: CAST(r[i] AS INTEGER) * (11 - i))) + CASE WHEN upper(r[10]) = 'X' THEN 10 ELSE CAST(r[10] AS INTEGER) END) % 11 = 0
  THEN '978' || r[1:9] || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(('978' || r)[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS INTEGER) END AS isbn13 FROM runs)
SELECT page_id, isbn13, count(*) AS hits FROM checked WHERE isbn13 IS NOT NULL GROUP BY ALL""", derived=False)
def isbn_scan(spark, d):
    """All ISBNs in the pages, to which each a right one, the same in ten signs, a wrong one and one with a dash are added."""
    s = lambda x: x.cast("string")
    n = F.lpad(s(F.col("page_id") * 7919 % 1_000_000_000), 9, "0")
    first = F.concat(F.lit("978"), n)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.substring(n, i, F.lit(1)).cast("int") * (F.lit(11) - i)), F.lit(0), lambda a, x: a + x)
    c10, c13 = (F.lit(11) - total % 11) % 11, T.isbn13_digit(first)
    ten, right, wrong = F.concat(n, F.when(c10 == 10, "X").otherwise(s(c10))), F.concat(first, s(c13)), F.concat(first, s((c13 + 1) % 10))
    html = F.concat(F.lit('<p id="'), right, F.lit('">'), "html", F.lit(" "), ten, F.lit(", not "), wrong, F.lit(" or "), right, F.lit("-2"))
    return A.table(spark, d, "pages").select("page_id", F.explode(T.isbn_hits(html)["isbn13"]).alias("isbn13")).groupBy("page_id", "isbn13").agg(F.count("*").alias("hits"))


@query("""SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS local_day, CAST(ts AS DATE) AS utc_day, strftime(CAST(ts AS DATE), '%m-%d (%a)') AS label FROM events""", derived=False)
def local_days(spark, d):
    return A.table(spark, d, "events").select("event_id", T.local_date(F.col("ts")).alias("local_day"), F.to_date("ts").alias("utc_day"), T.day_label(F.to_date("ts")).alias("label"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field, regexp_replace(trim(text), '[^\\p{L}\\p{N}._-]+', '_', 'g') AS file FROM documents""", derived=False)
def csv_fields(spark, d):
    text = F.col("text")
    return A.table(spark, d, "documents").select("doc_id", T.csv_field(text).alias("field"), T.file_name(text).alias("file"))
