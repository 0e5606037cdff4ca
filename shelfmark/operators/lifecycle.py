"""Retention: what may be trimmed, pruned or archived, and how long the space lasts.

These return what would go or stay; nothing is deleted in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.staging import staged


def trim_depth(rankings: DataFrame, depths: dict[str, int], otherwise: int) -> DataFrame:
    """List rows beyond their kind's depth."""
    depth = F.lit(otherwise)
    for kind, n in depths.items():
        depth = F.when(F.col("kind") == kind, F.lit(n)).otherwise(depth)
    return rankings.where(F.col("rank") > depth)


def decided(matches: DataFrame) -> DataFrame:
    """Items on either side of a person's decision."""
    own = matches.where(F.col("decision").startswith("manual"))
    return own.select(F.col("a").alias("store_book_id")).union(own.select("b")).distinct()


def alive_items(recent: DataFrame, ranked: DataFrame, matches: DataFrame) -> DataFrame:
    """Seen recently, ranked, or decided by a person."""
    return recent.select("store_book_id").union(ranked.select("store_book_id")).union(decided(matches)).distinct()


def dormant_items(items: DataFrame, alive: DataFrame) -> DataFrame:
    """Items that are not alive and whose book has no item that is."""
    kept = items.join(alive, "store_book_id", "left_semi").where("book_id IS NOT NULL").select("book_id").distinct()
    return items.join(alive, "store_book_id", "left_anti").join(kept, "book_id", "left_anti")


def orphan_books(books: DataFrame, items: DataFrame) -> DataFrame:
    """Books to which no item is linked."""
    return books.join(items.where("book_id IS NOT NULL").select("book_id").distinct(), "book_id", "left_anti")


def wiped(rows: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """What stays when a range of days is wiped."""
    return rows.where(~F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def archive_plan(rows: DataFrame, day: str, today: str, keep_days: int, min_keep: int, most: int = 14) -> DataFrame:
    """Oldest days beyond retention, at most so many in a run, with their rows."""
    keep = max(keep_days, min_keep)
    old = rows.where(F.col(day) < F.date_sub(F.lit(today).cast("date"), keep))
    return old.groupBy(day).agg(F.count("*").alias("rows")).orderBy(day).limit(most)


def archive_range(archives: DataFrame, today: str) -> DataFrame:
    """First and last day, days, rows, next expiry and days left until it (rounded up, not below 0)."""
    now = F.lit(today).cast("timestamp")
    expiry = F.min(F.when(F.col("expires_at") > now, F.col("expires_at")))
    one = archives.agg(F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"), F.countDistinct("snapshot_date").alias("days"), F.sum("row_count").alias("rows"), expiry.alias("expires_at"))
    left = F.greatest(F.lit(0), F.ceil((F.unix_timestamp("expires_at") - F.unix_timestamp(now)) / 86400))
    return one.withColumn("days_left", left.cast("long")).withColumn("expires_at", F.to_date("expires_at"))


def expiry_groups(archives: DataFrame, today: str, urgent_days: int) -> DataFrame:
    """Files that go together: their days as text and count; urgent if they go within so many days."""
    own = archives.groupBy("expires_at", "run").agg(F.array_join(F.sort_array(F.collect_set(F.col("snapshot_date").cast("string"))), ",").alias("dates"), F.count("*").alias("files"))
    return own.withColumn("urgent", F.datediff("expires_at", F.lit(today).cast("date")) <= urgent_days)


def capacity(measured: DataFrame, limit_mb: float, today: str) -> DataFrame:
    """Size now, growth a day since the nearest measure at least 7 days back (else the oldest), days left, diagnosis."""
    day = F.lit(today).cast("date")
    old = F.coalesce(F.max(F.when(F.col("day") <= F.date_sub(day, 7), F.struct("day", "mb"))), F.min(F.struct("day", "mb")))
    one = measured.agg(F.max(F.struct("day", "mb")).alias("now"), old.alias("old"))
    span = F.datediff("now.day", "old.day")
    grown = F.when(span > 0, (F.col("now.mb") - F.col("old.mb")) / span)
    one = one.select(F.col("now.mb").alias("mb"), F.round(grown, 4).alias("mb_a_day"), F.when(grown > 0, F.floor((F.lit(limit_mb) - F.col("now.mb")) / grown).cast("long")).alias("days_left"))
    used = F.col("mb") / limit_mb
    state = F.when(used >= 0.9, "bad").when(used >= 0.75, "warn").when(F.col("days_left") < 30, "soon").otherwise("ok")
    return one.withColumn("state", state)


def growth_a_day(first_seen: DataFrame, today: Column, days: Column, sizes: DataFrame, window: int = 3) -> Column:
    """MB by which the catalog grows a day; null if it can't be told: fewer than two days of data, or no new item.

    first_seen: first_seen of each item. The items that were new in the last `window` days before today (fewer, if there aren't as many behind the first day,
    which has everything new) are weighed with the catalog's bytes for each item. sizes: group, bytes, items.
    """
    span = F.least(F.lit(window), days - 1)
    new = first_seen.where((F.col("first_seen") < today) & (F.col("first_seen") >= F.date_sub(today, span.cast("int")))).agg(F.count("*")).scalar()
    weight = sizes.where("`group` = 'catalog'").agg(F.try_divide(F.sum("bytes").cast("double"), F.sum("items"))).scalar()
    return F.when((span > 0) & (new > 0) & (weight > 0), new / span * weight / 1e6)


def capacity_by_group(sizes: DataFrame, days: Column, growth: Column, limit_mb: float, keep: int, log_keep: int, prune_days: int | None = None, horizon: int = 365) -> DataFrame:
    """One row: MB in all and by group, MB a day, MB a year on, days until the limit, and the first thing that is wrong.

    sizes: group (daily: leaves after `keep` days, at least 14; slow: leaves after `log_keep`; any other: the catalog), bytes. growth: MB a day of the catalog,
    null if unknown. prune_days: what the catalog is pruned to, None if it isn't. days_left is 999 if the limit is never met.
    """
    mb = lambda group: F.coalesce(F.sum(F.when(F.col("group") == group, F.col("bytes"))), F.lit(0)) / 1e6
    one = sizes.agg((F.coalesce(F.sum("bytes"), F.lit(0)) / 1e6).alias("total"), mb("daily").alias("daily"), mb("slow").alias("slow"))
    one = one.withColumn("catalog", F.greatest(F.lit(0.0), F.col("total") - F.col("daily") - F.col("slow"))).withColumn("_days", F.greatest(F.lit(1), days)).withColumn("growth", growth)
    grown, ahead = F.coalesce("growth", F.lit(0.0)), F.lit(horizon) if prune_days is None else F.greatest(F.lit(0), F.lit(prune_days) - F.col("_days"))
    one = one.withColumn("per_day", F.col("daily") / F.col("_days"))
    one = one.withColumn("steady", F.col("catalog") + grown * ahead + F.col("per_day") * max(14, keep) + F.col("slow") / F.col("_days") * max(1, log_keep))
    rate = F.col("per_day") + F.col("slow") / F.col("_days") + grown
    left = F.when((F.col("steady") <= limit_mb) | (rate <= 0), 999).otherwise(F.floor(F.greatest(F.lit(0.0), limit_mb - F.col("total")) / rate)).cast("long")
    stale = F.lit(False) if prune_days is None else (grown > 0) & (F.col("catalog") > grown * prune_days * 2)
    never = F.lit(prune_days is None) & (grown > 0)
    state = F.when(F.col("growth").isNull(), "growth unknown").when(never, "never pruned").when(stale, "not pruned lately").when(F.col("steady") > limit_mb, "over the limit in a year")
    one = one.withColumn("days_left", left).withColumn("state", state.when(F.col("days_left") < 7, "full within a week").when(F.col("total") > limit_mb * 0.9, "nearly full").otherwise("ok"))
    return one.select(*(F.round(c, 6).alias(c) for c in ("total", "daily", "slow", "catalog", "growth", "per_day", "steady")), "days_left", "state")


def trim_by_list(rankings: DataFrame, depths: DataFrame, by_kind: dict[str, int], otherwise: int) -> DataFrame:
    """List rows beyond the depth of their store's list of that kind and category; beyond their kind's, if depths has none for it.

    depths: store_id, kind, unified, depth; a row for each list, so it is sent to the list rows, which stay where they are. Of several for one list the greatest counts, so that nothing goes too early.
    """
    depth = F.lit(otherwise)
    for kind, n in by_kind.items():
        depth = F.when(F.col("kind") == kind, F.lit(n)).otherwise(depth)
    keys = ["store_id", "kind", "unified"]
    own = rankings.join(F.broadcast(depths.groupBy(*keys).agg(F.max("depth").alias("_depth"))), keys, "left")
    return own.where(F.col("rank") > F.coalesce("_depth", depth)).select(*rankings.columns)


def prune_log(logs: DataFrame, day: str, today: str, keep_days: int) -> DataFrame:
    """Log rows that stay; at least 30 days do."""
    return logs.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), max(30, keep_days)))


def cascade(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str | None]], of: str, ids: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What is left of each table once the rows `ids` (id) of table `of` are deleted, and the ids that went from each table.

    tables: by name, each with a column id. keys: (child, column, parent, label): with label None a child's row goes with the parent that its column
    names; else the column becomes null, and the child's column of the label's name keeps the parent's last label. The graph of the keys may have any depth
    and may lead back to a table: what goes is followed until nothing new does, each step being written. Null references stay.
    """
    gone = {of: staged(tables[of].join(ids.select("id").distinct(), "id", "left_semi").select("id"), "gone")}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for child, column, parent, label in keys:
            if label is None and parent in fresh:
                hit = tables[child].join(fresh[parent].select(F.col("id").alias(column)), column, "left_semi").select("id")
                found[child] = found[child].unionByName(hit) if child in found else hit
        fresh = {}
        for child, hit in found.items():
            new = hit.distinct().join(gone[child], "id", "left_anti") if child in gone else hit.distinct()
            new = staged(new, "gone")
            if not new.isEmpty():
                fresh[child] = new
                gone[child] = gone[child].unionByName(new) if child in gone else new
    left = {name: df.join(gone[name], "id", "left_anti") if name in gone else df for name, df in tables.items()}
    for child, column, parent, label in keys:
        if label is not None and parent in gone:
            dead = tables[parent].join(gone[parent], "id", "left_semi").select(F.col("id").alias("_dead"), F.col(label).alias("_label"))
            columns = left[child].columns
            met = left[child].join(dead, F.col(column) == F.col("_dead"), "left")
            met = met.withColumn(label, F.when(F.col("_dead").isNotNull(), F.col("_label")).otherwise(F.col(label))).withColumn(column, F.when(F.col("_dead").isNull(), F.col(column)))
            left[child] = met.select(*columns)
    return left, gone
