"""Batch quality: summaries of runs, count anomalies, repeated pages and lists, and the merge of new rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Share of the baseline that a batch must reach, if the list's end was seen or not, and the first day's floor.
REACHED, CUT_OFF, FIRST_DAY = 0.25, 0.5, 10


def crawl_summary(logs: DataFrame, today: str, days: int) -> DataFrame:
    """Per store and day, over days + 1 calendar days up to today: runs, successes, failures, items, last end."""
    rows = logs.where(F.col("snapshot_date").between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date")))
    ok = F.col("status") == "success"
    return rows.groupBy("store_id", "snapshot_date").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"), F.sum(F.when(ok, F.col("items")).otherwise(0)).alias("items"), F.max("finished").alias("finished"), F.count_if(F.col("finished").isNull()).alias("unfinished"))


def baseline(logs: DataFrame, keys: list[str], before: str, last: int = 7) -> DataFrame:
    """The upper median of each key's last positive successful counts before a date."""
    rows = logs.where((F.col("status") == "success") & (F.col("items") > 0) & (F.col("snapshot_date") < F.lit(before).cast("date")))
    own = rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("snapshot_date"), F.desc("log_id")))).where(F.col("k") <= last)
    values = F.array_sort(F.collect_list("items"))  # at most `last` of them
    return own.groupBy(*keys).agg(values.alias("v")).select(*keys, F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("baseline"))


def count_floor(baseline_: Column, want: Column, reached_end: Column) -> Column:
    """The fewest items that pass: a share of the smaller of baseline and want; a floor on the first day."""
    base = F.least(baseline_, want)
    return F.when(baseline_.isNull(), F.lit(FIRST_DAY)).otherwise(F.floor(base * F.when(reached_end, REACHED).otherwise(CUT_OFF))).cast("int")


def twin_lists(rankings: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Lists that hold exactly the same items: their fingerprint and how many there are.

    A fingerprint is the size and two sums of item hashes, so no list is gathered into one value.
    """
    lists = rankings.select(*keys, item).distinct().groupBy(*keys).agg(F.count(item).alias("n"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(item, F.lit(1)).cast("decimal(38,0)")).alias("t"))
    same = W.partitionBy("n", "s", "t")
    return lists.withColumn("twins", F.count("*").over(same)).where("twins > 1").drop("s", "t")


def dedupe_ranks(rows: DataFrame, keys: list[str], item: str, rank: str) -> DataFrame:
    """First occurrence of each item in a list, and whether more than a tenth of the list was dropped.

    Rows meet by list and item only; what a list has dropped is summed from there, a row a list, and sent back.
    """
    rest = [c for c in rows.columns if c not in (*keys, item, rank)]
    # A null comes first, as in an order.
    first = F.min(F.struct(rank, *rest)) if rest else F.struct(F.when(F.count(rank) == F.count("*"), F.min(rank)).alias(rank))
    own = rows.groupBy(*keys, item).agg(first.alias("_first"), F.count("*").alias("_n"))
    lists = own.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(((F.sum("_n") - F.count("*")) / F.sum("_n") > 0.1).alias("failed"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return own.join(F.broadcast(lists), same).select(*(F.col(f"_first.{c}").alias(c) if c in (rank, *rest) else F.col(c) for c in rows.columns), "failed")


def recycled_pages(rows: DataFrame, keys: list[str], page: str, item: str, share: float = 0.3) -> DataFrame:
    """Pages of which at least that share was on earlier pages of the list already."""
    first = rows.groupBy(*keys, item).agg(F.min(page).alias("first_page"))
    seen = rows.join(first, [*keys, item]).groupBy(*keys, page).agg(F.count("*").alias("n"), F.count_if(F.col("first_page") < F.col(page)).alias("again"))
    return seen.where(F.col("again") >= F.col("n") * share)


def todo_stores(logs: DataFrame, stores: DataFrame, date: str, enough: int) -> DataFrame:
    """Stores whose successful items of a day stay below what is enough."""
    done = logs.where((F.col("snapshot_date") == F.lit(date).cast("date")) & (F.col("status") == "success")).groupBy("store_id").agg(F.sum("items").alias("n")).where(F.col("n") >= enough)
    return stores.join(done, "store_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows unless a new one has their keys; of several new ones for a key the largest row stays."""
    order = [F.desc(c) for c in new.columns if c not in keys] or [F.lit(1)]
    fresh = new.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return old.join(fresh, keys, "left_anti").unionByName(fresh)


def retire(rows: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, enabled only while the configuration has them."""
    known = config.select(*keys).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, keys, "left").withColumn("enabled", F.col("enabled") & F.col("_known").isNotNull()).drop("_known")


def last_seen(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))
