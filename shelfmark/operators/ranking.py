"""Combined rankings over several stores' lists, and what is ranked from them.

A list row is (snapshot_date, store_id, kind, unified, rank, store_book_id, sales_point); offline lists never mix into
combined results, and items without a book are left out. A store without a rank has no share in the average.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ranks that are looked at unless said otherwise, by period.
DEPTH = {"daily": 300, "weekly": 500}


def period(kind: Column) -> Column:
    return F.when(kind == "weekly", "weekly").otherwise("daily")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def listed(rankings: DataFrame, store_books: DataFrame, date: str | None, of: str = "daily", unified: str = "all", depth: int | None = None) -> DataFrame:
    """List rows with a book, of one period and category ('*': any), to a depth."""
    rows = rankings.where((F.col("kind") != "offline") & (period(F.col("kind")) == of) & (F.col("rank") <= (depth or DEPTH[of])))
    if date is not None:
        rows = rows.where(F.col("snapshot_date") == F.lit(date).cast("date"))
    if unified != "*":
        rows = rows.where(F.col("unified") == unified)
    return rows.join(store_books.where("book_id IS NOT NULL").select("store_book_id", "book_id"), "store_book_id")


def combined_rows(rows: DataFrame, *also: str) -> DataFrame:
    """book_id, store_count, avg_rank, ranks and sales (maps by store), for each of `also` (such as a date) by itself.

    A store counts with its best rank; its sales are those of that rank, even if unknown there.
    """
    keys = [*also, "book_id"]
    best = rows.groupBy(*keys, "store_id").agg(F.min("rank").alias("rank"), F.min_by("sales_point", F.struct("rank", "unified", "store_book_id")).alias("sales"))
    return best.groupBy(*keys).agg(
        F.count("*").alias("store_count"),
        half_up(F.sum("rank").cast("decimal(18,6)") / F.count("*"), 1).alias("avg_rank"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("store_id", "rank")))).alias("ranks"),
        F.map_from_entries(F.sort_array(F.filter(F.collect_list(F.struct("store_id", "sales")), lambda x: x["sales"].isNotNull()))).alias("sales"),
    )


def by_store(df: DataFrame, stores: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Maps by store as columns rank_s1, ... and sales_s1, ..."""
    extra = {f"rank_s{s}": F.col("ranks").getItem(s) for s in stores} | {f"sales_s{s}": F.col("sales").getItem(s) for s in stores}
    return df.withColumns(extra).drop("ranks", "sales")


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("avg_rank"), F.desc("store_count"), "book_id")


def combined_best(rows: DataFrame, books: DataFrame, min_stores: int = 1, limit: int = 100) -> DataFrame:
    """The best books of combined rows; the limit is a top-k of 1 to 500."""
    top = in_order(combined_rows(rows).where(F.col("store_count") >= min_stores)).limit(clamp(limit, 1, 500))
    # At most 500 rows: they are sent to the books, not the other way round.
    return in_order(books.join(F.broadcast(top), "book_id"))


def name_ranking(rows: DataFrame, books: DataFrame, name: Column, depth: int, limit: int = 100) -> DataFrame:
    """name, books, best, score, titles: publishers or authors by the sum of depth + 1 - avg_rank over their books."""
    own = combined_rows(rows).join(books, "book_id").withColumn("name", name).where("name IS NOT NULL AND name <> ''")
    points = F.greatest(F.lit(0.0), F.lit(float(depth + 1)) - F.col("avg_rank"))
    # Places come before the sums, in the same partitions by name, so a list is derived and dealt out once.
    own = own.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("avg_rank", "book_id")))
    titles = F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "title"))))
    figures = own.groupBy("name").agg(
        F.countDistinct("book_id").alias("books"), F.min("avg_rank").alias("best"), half_up(F.sum(points.cast("decimal(18,1)")), 0).cast("long").alias("score"),
        F.concat_ws(" / ", F.transform(titles, lambda x: x["title"])).alias("titles"))
    return figures.orderBy(F.desc("score"), "best", "name").limit(clamp(limit, 1, 300))


def publisher_name(column: str = "publisher") -> Column:
    """A publisher without corporate markers."""
    return F.nullif(F.trim(F.regexp_replace(column, r"\b(?:Inc|Ltd|Co)\.", "")), F.lit(""))


def category_share(rankings: DataFrame, store_books: DataFrame, date: str, of: str = "daily", top: int = 100) -> DataFrame:
    """unified, books: in how many other categories the top books are listed; a book counts once in each.

    The few top books drive the join, so only their rows of the lists are counted.
    """
    best = in_order(combined_rows(listed(rankings, store_books, date, of))).limit(clamp(top, 1, 500)).select("book_id")
    rows = listed(rankings.where("unified <> 'all'"), store_books, date, of, "*")
    return rows.join(F.broadcast(best), "book_id").select("unified", "book_id").distinct().groupBy("unified").agg(F.count("*").alias("books"))


def unified_options(rankings: DataFrame) -> DataFrame:
    """unified, label: of the names that stores give a category the shortest, then the first."""
    names = rankings.select("unified", F.concat("unified", F.lit("-"), "kind").alias("name")).distinct()
    return names.groupBy("unified").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("label"))


def books_by_ids(ids: list[int], books: DataFrame, rows: DataFrame) -> DataFrame:
    """Combined figures of chosen books, also of those that are not ranked."""
    return books.where(F.col("book_id").isin(ids)).join(combined_rows(rows.where(F.col("book_id").isin(ids))), "book_id", "left")


def snapshot_dates(rankings: DataFrame, limit: int = 30) -> DataFrame:
    return rankings.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(limit)


def previous_dates(rankings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, snapshot_date, previous: each list's snapshot before."""
    dates = rankings.select(*keys, "snapshot_date").distinct()
    return dates.withColumn("previous", F.lag("snapshot_date").over(W.partitionBy(*keys).orderBy("snapshot_date")))


def category_rank_change(rankings: DataFrame, date: str) -> DataFrame:
    """Rows of a date with the rank in the same list's previous snapshot.

    change: ranks won; null without a previous snapshot or for new items; is_new only if there is a previous one.
    """
    keys = ["store_id", "kind", "unified"]
    dates = previous_dates(rankings, keys).where(F.col("snapshot_date") == F.lit(date).cast("date"))
    # A few dates at most, which reach the scan of the earlier lists as a filter.
    asked = [r.previous for r in dates.where("previous IS NOT NULL").select("previous").distinct().collect()]
    today = rankings.where(F.col("snapshot_date") == F.lit(date).cast("date")).join(dates.drop("snapshot_date"), keys)
    before = rankings.where(F.col("snapshot_date").isin(asked) if asked else F.lit(False)).select(*keys, F.col("snapshot_date").alias("previous"), "store_book_id", F.col("rank").alias("old_rank"))
    out = today.join(before, [*keys, "previous", "store_book_id"], "left")
    return out.withColumn("change", F.col("old_rank") - F.col("rank")).withColumn("is_new", F.col("previous").isNotNull() & F.col("old_rank").isNull())


def positions(rows: DataFrame, min_stores: int, limit: int) -> DataFrame:
    """book_id, position in the combined list of at most `limit` books."""
    top = in_order(combined_rows(rows).where(F.col("store_count") >= min_stores)).limit(limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(F.asc_nulls_last("avg_rank"), F.desc("store_count"), "book_id"))).select("book_id", "position")


def combined_rank_change(today: DataFrame, before: DataFrame, min_stores: int = 1, limit: int = 500) -> DataFrame:
    """book_id, position, old_position, change, is_new.

    Nothing is said if there is no list before or it has other stores; a book that is absent from a list cut at the limit
    is unknown, not new.
    """
    now, old = positions(today, min_stores, limit), positions(before, min_stores, limit)
    state = old.agg(F.count("*").alias("n"))
    stores = [x.agg(F.sort_array(F.collect_set("store_id")).alias(name)) for x, name in ((today, "s"), (before, "t"))]
    guard = state.crossJoin(stores[0]).crossJoin(stores[1]).select(((F.col("s") == F.col("t")) & (F.col("n") > 0)).alias("comparable"), "n")
    out = now.join(old.withColumnRenamed("position", "old_position"), "book_id", "left").crossJoin(F.broadcast(guard))
    return out.select(
        "book_id", "position", F.when(F.col("comparable"), F.col("old_position")).alias("old_position"),
        F.when(F.col("comparable"), F.col("old_position") - F.col("position")).alias("change"),
        F.when(F.col("comparable") & F.col("old_position").isNotNull(), F.lit(False)).when(F.col("comparable") & (F.col("n") < limit), F.lit(True)).alias("is_new"),
    )


def report_changes(rankings: DataFrame, store_books: DataFrame, date: str, depth: int = 300, limit: int = 100, big: int = 5, before: str | None = None) -> DataFrame:
    """book_id, position, old_position, mark (new, up, down) against the calendar's day before, or the list of `before`.

    No rows if that list is empty, even if there is an older one.
    """
    yesterday = F.lit(before).cast("date") if before else F.date_sub(F.lit(date).cast("date"), 1)
    lists = [positions(listed(rankings.where(F.col("snapshot_date") == day), store_books, None, depth=depth), 1, limit) for day in (F.lit(date).cast("date"), yesterday)]
    some = lists[1].agg((F.count("*") > 0).alias("some"))
    out = lists[0].join(lists[1].withColumnRenamed("position", "old_position"), "book_id", "left").crossJoin(F.broadcast(some)).where("some").drop("some")
    change = F.col("old_position") - F.col("position")
    return out.withColumn("mark", F.when(F.col("old_position").isNull(), "new").when(change >= big, "up").when(change <= -big, "down")).where("mark IS NOT NULL")


def share_rankings(links: DataFrame, rankings: DataFrame, now: str, limit: int = 100) -> DataFrame:
    """token, snapshot_date, rank, store_book_id: lists that live links show.

    A link's target is 'unified' or 'unified@date'; without a date it shows the latest. It is live while enabled and not
    expired.
    """
    live = links.where(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    parts = F.split("target", "@")
    live = live.select("token", parts.getItem(0).alias("unified"), F.try_to_date(F.get(parts, F.lit(1))).alias("asked"))
    own = rankings.where("kind = 'online'")
    latest = own.groupBy("unified").agg(F.max("snapshot_date").alias("latest"))
    live = live.join(latest, "unified").select("token", "unified", F.coalesce("asked", "latest").alias("snapshot_date"))
    return own.join(live, ["unified", "snapshot_date"]).where(F.col("rank") <= clamp(limit, 1, 200)).select("token", "snapshot_date", "store_id", "rank", "store_book_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
