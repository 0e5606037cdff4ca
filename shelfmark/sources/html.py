"""Rows from HTML pages, page diagnosis, and robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import isbn_hits, isbn_in_address, parse_prices, parse_year_month, role_author
from shelfmark.sources.boxes import boxes, field
from shelfmark.sources.robots import verdicts

#: Words that a blocked page shows; own vocabulary.
BLOCKED = ["captcha", "access denied", "unusual traffic"]
SHORT = 200


def summary(pages: DataFrame) -> DataFrame:
    """page_id, title, heading, links, text_chars."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<!--.*?-->|<[^>]*>", "")
    return pages.select(
        "page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_count("html", F.lit(r"<a href=")).cast("long").alias("links"), F.length(body).cast("long").alias("text_chars"))


def listing(pages: DataFrame, size: int = 20) -> DataFrame:
    """page_id, rank, item of each list entry that is a link; rank goes on from page to page by `size`."""
    items = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">'), 1)
    return pages.select("page_id", F.posexplode(items).alias("k", "item")).select("page_id", (F.col("page_id") * size + F.col("k") + 1).cast("long").alias("rank"), "item")


def with_roles(text: Column) -> Column:
    """array of struct(name, role) of 'Name (role), Name (role)'; without brackets the role is null."""
    people = F.filter(F.split(text, r"\s*,\s*"), lambda x: F.trim(x) != "")
    return F.transform(people, lambda x: F.struct(F.trim(F.regexp_replace(x, r"\([^)]*\)", "")).alias("name"), F.nullif(F.regexp_extract(x, r"\(([^)]*)\)", 1), F.lit("")).alias("role")))


def products(pages: DataFrame, size: int = 20, roles: tuple[str, ...] = ("writer", "editor", "translator")) -> DataFrame:
    """key, page, rank, title, author, authors, list_price, sale_price, pub_ym, isbn13, cover of each product on listing pages.

    pages: page (from 1), html. A product is a list item of class product; one without a key or title is none. The rank is
    the one it shows, else its place, going on from page to page by `size`. Of several authors the one whose role comes
    first counts. An ISBN is taken from addresses first, then from the text, if its check digit is right.
    """
    rows = boxes(pages.select("page", "html"))
    people, price = with_roles(field("author")), parse_prices(field("price"))
    rank = F.coalesce(F.regexp_extract(field("rank"), r"(\d+)", 1).try_cast("int"), ((F.col("page") - 1) * size + F.col("place") + 1).cast("int"))
    out = rows.select(
        F.nullif("key", F.lit("")).alias("key"), "page", rank.alias("rank"), field("title").alias("title"), role_author(people, list(roles)).alias("author"),
        F.array_join(F.transform(people, lambda x: x["name"]), ", ").alias("authors"), price["list_price"].alias("list_price"), price["sale_price"].alias("sale_price"),
        parse_year_month(field("date")).alias("pub_ym"), F.coalesce(isbn_in_address(F.array_join("links", " "))["isbn13"], F.get(isbn_hits(F.col("text"))["isbn13"], F.lit(0))).alias("isbn13"), "cover")
    return out.where("key IS NOT NULL AND title <> ''")


def diagnosis(pages: DataFrame) -> DataFrame:
    """page_id, state: blocked, short, no_article, or ok."""
    low = F.lower("html")
    blocked = F.lit(False)
    for word in BLOCKED:
        blocked = blocked | F.contains(low, F.lit(word))
    state = F.when(F.coalesce(F.length("html"), F.lit(0)) < SHORT, "short").when(blocked, "blocked").when(~F.contains("html", F.lit("<article>")), "no_article").otherwise("ok")
    return pages.select("page_id", state.alias("state"))


def robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, allowed by rules (pattern, allow and, if they are of one host each, host); see sources.robots."""
    return verdicts(pages, rules).select("page_id", "allowed")
