"""Substring search and keyset paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import clamp


def contains(term: str, *columns: str) -> Column:
    """Whether any of the columns holds the term, whatever the case; the term is taken literally."""
    low = term.lower()
    return reduce(Column.__or__, (F.contains(F.lower(c), F.lit(low)) for c in columns))


def search_merged(term: str, books: DataFrame, rankings: DataFrame, store_books: DataFrame, limit: int = 100, most: int | None = None) -> DataFrame:
    """Books with the term in title, author or publisher: stores, last date and best rank, titles that start with it first.

    All hits are ranked; `most` looks up only the first so many by id, for a quick answer that may miss better ones.
    """
    hit = books.where(contains(term, "title", "author", "publisher")).select("book_id", "title", "author", "publisher")
    hit = hit.orderBy("book_id").limit(most) if most else hit
    items = store_books.join(hit.select("book_id"), "book_id").select("store_book_id", "book_id")
    seen = rankings.where("kind <> 'offline'").join(items, "store_book_id").groupBy("book_id").agg(
        F.array_join(F.sort_array(F.collect_set("store_id")).cast("array<string>"), ",").alias("stores"), F.max("snapshot_date").alias("last_seen"), F.min("rank").alias("best"))
    starts = F.startswith(F.lower("title"), F.lit(term.lower()))
    return hit.join(seen, "book_id", "left").orderBy(starts.desc(), F.desc_nulls_last("last_seen"), F.asc_nulls_last("best"), "book_id").limit(clamp(limit, 1, 200))


def keyset(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next page behind a key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
