"""Readable exports, day-wise appends, and how far stores agree on identifiers and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import csv_field
from shelfmark.operators.matching import TITLE_FLOOR, similarity


def csv_line(*fields: Column) -> Column:
    """One line of CSV without its end; null is blank."""
    return F.concat_ws(",", *(csv_field(f.cast("string")) for f in fields))


def readable(rankings: DataFrame, items: DataFrame, stores: DataFrame, lists: Column | None = None) -> DataFrame:
    """snapshot_date, store_id, kind, unified, rank, line: list rows with names in place of ids.

    items: store_book_id, title; stores: store_id, store. Rows whose item or store is unknown stay, with blanks. lists: an array of
    (kind, unified, rank), if a row of rankings stands for several lists; it is told for each of them when its names are known.
    """
    named = rankings.join(items.select("store_book_id", "title"), "store_book_id", "left").join(F.broadcast(stores), "store_id", "left")
    if lists is not None:
        named = named.select("snapshot_date", "store_id", "store", "title", "sales_point", F.inline(lists))
    line = csv_line(F.col("snapshot_date"), F.col("store"), F.col("kind"), F.col("unified"), F.col("rank"), F.col("title"), F.col("sales_point"))
    return named.select("snapshot_date", "store_id", "kind", "unified", "rank", line.alias("line"))


HEADER = "date,store,kind,list,rank,title,sales"


def write_readable(lines: DataFrame, path: str) -> None:
    """A CSV file for each day, to be read by people: a byte order mark and a header, then lines in order of store, kind, list
    and rank, with CRLF ends. A day is one file in order, so one task writes it."""
    head = lines.select("snapshot_date").distinct().withColumn("line", F.lit("\ufeff" + HEADER))
    ordered = lines.unionByName(head, True).repartition("snapshot_date").sortWithinPartitions("snapshot_date", F.asc_nulls_first("store_id"), "kind", "unified", "rank")
    ordered.select("snapshot_date", "line").write.mode("overwrite").partitionBy("snapshot_date").option("lineSep", "\r\n").text(path)


def append_days(sheet: DataFrame, rows: DataFrame, day: str, today: str, keep_days: int) -> DataFrame:
    """The sheet with the days that it does not have yet, and without those older than keep_days."""
    fresh = rows.join(sheet.select(day).distinct(), day, "left_anti").select(*sheet.columns)
    return sheet.unionByName(fresh).where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep_days))


def coverage(items: DataFrame) -> DataFrame:
    """store_id, items, with_isbn, with_price, isbn_percent."""
    out = items.groupBy("store_id").agg(F.count("*").alias("items"), F.count("isbn13").alias("with_isbn"), F.count("list_price").alias("with_price"))
    return out.withColumn("isbn_percent", F.round(F.col("with_isbn") * 100 / F.col("items"), 1))


def agreement(items: DataFrame) -> DataFrame:
    """store_a, store_b, pairs, same_title, alike_title (likeness of .60 or more), same_price: items of two stores with one ISBN."""
    own = items.where("isbn13 IS NOT NULL").select("isbn13", "store_id", "title", "list_price")
    x, y = (own.select("isbn13", *(F.col(c).alias(f"{s}_{c}") for c in ("store_id", "title", "list_price"))) for s in "xy")
    met = x.join(y, "isbn13").where("x_store_id < y_store_id")
    return met.groupBy(F.col("x_store_id").alias("store_a"), F.col("y_store_id").alias("store_b")).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("x_title") == F.col("y_title")).alias("same_title"), F.count_if(similarity(F.col("x_title"), F.col("y_title")) >= TITLE_FLOOR).alias("alike_title"), F.count_if(F.col("x_list_price") == F.col("y_list_price")).alias("same_price"))


def month_to_date(rows: DataFrame, at: str, amount: str, today: str) -> DataFrame:
    """n and total of the month that `today` lies in, up to it, exact to the cent."""
    day = F.lit(today).cast("date")
    own = rows.where((F.to_date(at) >= F.trunc(day, "month")) & (F.to_date(at) <= day))
    return own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.round(F.col(amount) * 100).cast("long")), F.lit(0)).alias("cents"))
