"""Review of match decisions: bands, sizes, worklists, and merging what people decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def band(score: Column) -> Column:
    """Lower end of the score's band: eight of width 5 from 60, the last up to 100; null below 60 or above 100."""
    return F.when(score.between(60, 100), F.least(F.lit(95), (F.floor(score / 5) * 5).cast("int")))


def size_group(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n == 3, "3").otherwise("4+")


def score_bands(matches: DataFrame) -> DataFrame:
    return matches.groupBy(band(F.col("score")).alias("band"), "decision").agg(F.count("*").alias("n"))


def group_sizes(items: DataFrame) -> DataFrame:
    """store_book_id, members of its book, group."""
    own = items.where("book_id IS NOT NULL").withColumn("members", F.count("*").over(W.partitionBy("book_id")))
    return own.select("store_book_id", "members", size_group(F.col("members")).alias("size_group"))


def touching(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs of which either side is in ids: the union of two semi-joins, as an OR would not be an equi-join."""
    sides = [matches.join(ids.select(F.col("id").alias(s)), s, "left_semi").select(*matches.columns) for s in ("a", "b")]
    return sides[0].union(sides[1]).distinct()


def worklist(matches: DataFrame, decision: str, low: int, page: int, size: int) -> DataFrame:
    """A page of pairs with a decision and at least a score."""
    rows = matches.where((F.col("decision") == decision) & (F.col("score") >= low))
    return rows.orderBy(F.desc("score"), "a", "b").offset((page - 1) * size).limit(size)


def merge_decisions(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs after events (seq, a, b, action: merge, split or undo), the last of each pair counting.

    undo restores the automatic decision; a pair that was not there gets score 0.
    """
    events = events.select("seq", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "action")
    last = events.groupBy("a", "b").agg(F.max_by("action", F.struct("seq", "action")).alias("action"))
    new = F.when(F.col("action") == "merge", "manual_merge").when(F.col("action") == "split", "manual_split").when(F.col("action") == "undo", F.col("auto_decision")).otherwise(F.col("decision"))
    out = matches.select("a", "b", "score", "decision", "auto_decision").join(last, ["a", "b"], "full_outer")
    return out.select("a", "b", F.coalesce("score", F.lit(0)).alias("score"), new.alias("decision"), "auto_decision").where("decision IS NOT NULL OR score > 0")


def join_pairs(ids: DataFrame) -> DataFrame:
    """All pairs of a chosen handful of ids (at most 6)."""
    few = ids.select("id").distinct().orderBy("id").limit(6)
    x, y = few.alias("x"), few.alias("y")
    return x.join(F.broadcast(y), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def join_requests(chosen: DataFrame, items: DataFrame, most: int = 6) -> DataFrame:
    """request, n, verdict of rows (request, id): ok, few (not two different ids), many (more than `most`) or gone (an id that no item has)."""
    ids = chosen.where("request IS NOT NULL").select("request", F.when(F.col("id") > 0, F.col("id")).alias("id")).distinct()
    known = ids.join(items.select(F.col("store_book_id").alias("id"), F.lit(1).alias("_known")).distinct(), "id", "left")
    counted = known.groupBy("request").agg(F.count("id").alias("n"), F.count("_known").alias("_found"))
    verdict = F.when(F.col("n") < 2, "few").when(F.col("n") > most, "many").when(F.col("_found") < F.col("n"), "gone").otherwise("ok")
    return counted.select("request", "n", verdict.alias("verdict"))


def forced_joins(matches: DataFrame, chosen: DataFrame, items: DataFrame, most: int = 6) -> DataFrame:
    """Matches after people's requests (request, id) to join items: all pairs of a request that is ok are merged by hand.

    A pair that was not there gets score 0 and the automatic decision 'rejected', which undoing it restores; one that was there keeps both. A request
    has `most` ids at most, so its pairs are few.
    """
    ids = chosen.where("id > 0").select("request", "id").distinct().join(join_requests(chosen, items, most).where("verdict = 'ok'").select("request"), "request", "left_semi")
    few = ids.groupBy("request").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = few.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").distinct().withColumn("_forced", F.lit(True))
    out = matches.select("a", "b", "score", "decision", "auto_decision").join(pairs, ["a", "b"], "full_outer")
    fresh = F.col("decision").isNull() & F.col("score").isNull()
    return out.select("a", "b", F.coalesce("score", F.lit(0)).alias("score"), F.when(F.col("_forced"), "manual_merge").otherwise(F.col("decision")).alias("decision"), F.when(fresh, "rejected").otherwise(F.col("auto_decision")).alias("auto_decision"))


def parse_decisions(lines: DataFrame) -> DataFrame:
    """CSV lines (n, line: id,decision,note) to id, decision, note, bucket; the last good line of an id counts.

    bucket: ok, blank (no decision), unknown (no such decision), bad_id, or replaced by a later line.
    """
    row = F.from_csv("line", "id string, decision string, note string", {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    out = lines.select("n", row.alias("r")).select("n", "r.*")
    number = F.expr("try_cast(id AS BIGINT)")
    word = F.lower(F.trim("decision"))
    bucket = F.when(number.isNull(), "bad_id").when(word.isNull() | (word == ""), "blank").when(~word.isin("merge", "split"), "unknown").otherwise("ok")
    out = out.select("n", number.alias("id"), word.alias("decision"), "note", bucket.alias("bucket"))
    later = F.lead("n").over(W.partitionBy("id", F.col("bucket") == "ok").orderBy("n"))
    return out.withColumn("bucket", F.when((F.col("bucket") == "ok") & later.isNotNull(), "replaced").otherwise(F.col("bucket")))


def relink_favorites(favorites: DataFrame, books: DataFrame) -> DataFrame:
    """user_id, book_id, title, relinked: a lost favourite gets the one book of its title, unless the user has it already."""
    one = books.groupBy("title").agg(F.count("*").alias("n"), F.min("book_id").alias("found")).where("n = 1").select("title", "found")
    have = favorites.where("book_id IS NOT NULL").select("user_id", F.col("book_id").alias("found")).distinct()
    lost = favorites.where("book_id IS NULL").join(one, "title").join(have, ["user_id", "found"], "left_anti").select("user_id", "title", "found")
    out = favorites.join(lost, ["user_id", "title"], "left")
    return out.select("user_id", F.coalesce("book_id", "found").alias("book_id"), "title", (F.col("book_id").isNull() & F.col("found").isNotNull()).alias("relinked"))
