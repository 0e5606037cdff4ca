"""Where stores disagree: majority votes over attributes, and audits of duplicates, growth and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def vote(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, winner (null on a tie or without votes), split (more than one value), known (votes)."""
    votes = rows.groupBy(key, value).agg(F.count(value).alias("n")).where("n > 0")
    top = F.max("n").over(W.partitionBy(key))
    counted = votes.withColumn("top", F.col("n") == top)
    won = counted.groupBy(key).agg(
        F.when(F.count_if("top") == 1, F.max(F.when(F.col("top"), F.col(value)))).alias("winner"), (F.count("*") > 1).alias("split"), F.sum("n").alias("known"))
    return rows.select(key).distinct().join(won, key, "left").select(key, "winner", F.coalesce("split", F.lit(False)).alias("split"), F.coalesce("known", F.lit(0)).alias("known"))


def price_audit(items: DataFrame, limit: int = 25) -> DataFrame:
    """Books whose stores disagree on the price, by the gap: strict majority, prices as text."""
    known = items.where("book_id IS NOT NULL AND list_price IS NOT NULL")
    prices = known.groupBy("book_id", "list_price").agg(F.count("*").alias("n"))
    total = prices.groupBy("book_id").agg(F.sum("n").alias("total"), F.count("*").alias("prices"), (F.max("list_price") - F.min("list_price")).alias("gap"))
    major = prices.join(total, "book_id").where(F.col("n") * 2 > F.col("total")).select("book_id", F.col("list_price").alias("majority"))
    text = known.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("store_id", "list_price"))), lambda x: F.concat(x["store_id"].cast("string"), F.lit(":"), x["list_price"].cast("string"))), " ").alias("detail"))
    out = total.where("prices > 1").join(major, "book_id", "left").join(text, "book_id")
    return out.select("book_id", "prices", "gap", "majority", "detail").orderBy(F.desc("gap"), "book_id").limit(limit)


def without_majority(items: DataFrame) -> DataFrame:
    """Books of at least two known prices of which none has more than half the votes."""
    known = items.where("book_id IS NOT NULL AND list_price IS NOT NULL")
    prices = known.groupBy("book_id", "list_price").agg(F.count("*").alias("n"))
    total = known.groupBy("book_id").agg(F.count("*").alias("total")).where("total > 1")
    major = prices.join(total, "book_id").where(F.col("n") * 2 > F.col("total"))
    return total.join(major, "book_id", "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and by how many rows too many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("surplus", F.col("n") - 1)


def share_of_total(rows: DataFrame, key: str) -> DataFrame:
    """key, n, percent of all rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2))


def growth(rows: DataFrame, key: str, day: str, stores: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """First appearances of keys by day and store."""
    first = rows.groupBy(key, "store_id").agg(F.min(day).alias(day))
    return first.groupBy(day).agg(*(F.count_if(F.col("store_id") == s).alias(f"new_s{s}") for s in stores), F.count("*").alias("total"))


def projection(days: DataFrame, day: str, horizon: int = 365) -> DataFrame:
    """Average of daily totals without the first day, and their linear projection."""
    first = days.agg(F.min(day).alias("first"))
    later = days.crossJoin(F.broadcast(first)).where(F.col(day) > F.col("first"))
    return later.agg(F.count("*").alias("days"), F.round(F.avg("total"), 2).alias("average"), F.round(F.avg("total") * horizon, 0).alias("projected"))


def unchanged(rows: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """Rows with the columns first (of their keys) and same (as the row before, nulls being equal)."""
    own = W.partitionBy(*keys).orderBy(day)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(own))
    return rows.withColumn("first", F.row_number().over(own) == 1).withColumn("same", F.when(F.col("first"), F.lit(False)).otherwise(same))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row for each key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def never_ranked(items: DataFrame, rankings: DataFrame) -> DataFrame:
    """Items that stand in none of the given lists, at whatever rank."""
    return items.join(rankings.select("store_book_id"), "store_book_id", "left_anti")


def decision_audit(matches: DataFrame) -> DataFrame:
    """check, n: one row for each count."""
    manual = F.col("decision").startswith("manual")
    counts = {"all": F.lit(True), "manual": manual, "automatic": ~manual, "no_auto": F.col("auto_decision").isNull(), "overruled": manual & F.col("auto_decision").isNotNull(), "auto_differs": ~manual & (F.col("auto_decision") != F.col("decision"))}
    one = matches.agg(*(F.count_if(x).alias(k) for k, x in counts.items()))
    return one.unpivot([], list(counts), "check", "n")
