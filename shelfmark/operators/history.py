"""A book's history over snapshots, where it stands now, and staleness of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.operators.ranking import period


def book_history(rankings: DataFrame, store_books: DataFrame, book_ids: list[int]) -> DataFrame:
    """Best row for each book, date, store, period and category. Days without data have no row.

    The items of the given ids are sent to the lists, which are not shuffled for them.
    """
    own = store_books.where(F.col("book_id").isin(book_ids)).select("store_book_id", "book_id")
    rows = rankings.join(F.broadcast(own), "store_book_id").withColumn("period", period(F.col("kind")))
    best = F.min_by(F.struct("rank", "sales_point"), F.struct("rank", "kind", "store_book_id")).alias("best")
    return rows.groupBy("book_id", "snapshot_date", "store_id", "period", "unified").agg(best).select("book_id", "snapshot_date", "store_id", "period", "unified", "best.rank", "best.sales_point")


def placements(history: DataFrame) -> DataFrame:
    """A book's rows on its latest date, numbered by store, overall list first, daily first, then rank."""
    last = history.groupBy("book_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    order = W.partitionBy("book_id").orderBy("store_id", F.col("unified") != "all", F.col("period") != "daily", "rank", "unified")
    return history.join(last, ["book_id", "snapshot_date"]).withColumn("place", F.row_number().over(order))


def category_choices(history: DataFrame) -> DataFrame:
    """book_id, period, unified, days, best: which lists a book can be shown in, the longest listed first."""
    own = history.groupBy("book_id", "period", "unified").agg(F.countDistinct("snapshot_date").alias("days"), F.min("rank").alias("best"))
    return own.withColumn("place", F.row_number().over(W.partitionBy("book_id").orderBy(F.desc("days"), "best", "period", "unified")))


def sparse_delta(history: DataFrame, value: str, better: str) -> DataFrame:
    """Rows whose value differs from the store's previous known value; better: 'low' or 'high'."""
    known = history.where(F.col(value).isNotNull())
    before = F.lag(value).over(W.partitionBy("book_id", "store_id", "period", "unified").orderBy("snapshot_date"))
    out = known.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))
    gain = F.col("before") - F.col(value) if better == "low" else F.col(value) - F.col("before")
    return out.withColumn("delta", gain).withColumn("improved", gain > 0)


def trend_series(history: DataFrame, days: int = 30) -> DataFrame:
    """A book's rows on its newest dates only."""
    return history.withColumn("back", F.dense_rank().over(W.partitionBy("book_id").orderBy(F.desc("snapshot_date")))).where(F.col("back") <= days)


def axis(series: DataFrame, value: str, least_span: int = 2000, pad: float = 0.15) -> DataFrame:
    """book_id, low, high: the value axis with padding, never below zero."""
    span = F.greatest((F.max(value) - F.min(value)).cast("double"), F.lit(float(least_span)))
    return series.where(F.col(value).isNotNull()).groupBy("book_id").agg(F.greatest(F.lit(0.0), F.min(value) - span * pad).alias("low"), (F.max(value) + span * pad).alias("high"))


def top_category_basis(history: DataFrame) -> DataFrame:
    """Best rank over all but the overall list, for each date, store and period."""
    rows = history.where("unified <> 'all'")
    return rows.groupBy("book_id", "snapshot_date", "store_id", "period").agg(F.min("rank").alias("rank"), F.min_by("unified", F.struct("rank", "unified")).alias("unified"))


def sales_first_seen(history: DataFrame) -> DataFrame:
    """One sales value for each date, store and period: that of the first list that has one."""
    order = W.partitionBy("book_id", "snapshot_date", "store_id", "period").orderBy("unified")
    return history.where("sales_point IS NOT NULL").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def best_of_duplicates(history: DataFrame) -> DataFrame:
    """One row for each date and store, with how many others there were."""
    return history.groupBy("book_id", "snapshot_date", "store_id").agg(F.min("rank").alias("rank"), F.min_by("unified", F.struct("rank", "unified", "period")).alias("unified"), (F.count("*") - 1).alias("others"))


def staleness(days: Column) -> Column:
    """ok below 2 days (also in the future), warn at 2, bad from 3; null stays null."""
    return F.when(days < 2, "ok").when(days < 3, "warn").when(days >= 3, "bad")


def rank_status(rank: Column, linked: Column) -> Column:
    """ranked, outside (linked, but not in the list), unlinked, or unknown (it is not known whether it is linked)."""
    return F.when(rank.isNotNull(), "ranked").when(linked.isNull(), "unknown").when(linked, "outside").otherwise("unlinked")


def scaled(value: Column, full: float) -> Column:
    """Percent of a full bar, at most 100."""
    return F.least(F.lit(100.0), value * 100.0 / full)


def tone(percent: Column) -> Column:
    """bad from 90 percent, warn from 75, else ok; null stays null."""
    return F.when(percent >= 90, "bad").when(percent >= 75, "warn").when(percent.isNotNull(), "ok")


def month_index(ym: Column) -> Column:
    """12 * year + month of 'YYYY-MM'; null if it isn't one."""
    ok = F.regexp_like(ym, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$"))
    return F.when(ok, F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 6, 2).cast("int"))
