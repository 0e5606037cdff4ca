"""Robots texts: from lines to groups of rules, the group for an agent, and verdicts on URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lines(texts: DataFrame) -> DataFrame:
    """host, grp, at, key, value: the lines 'key: value' of texts (host, text), without comments.

    Lines user-agent that follow each other open one group; what stands before the first has group 0.
    """
    split = texts.select("host", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "line"))
    told = split.withColumn("line", F.regexp_replace("line", "#.*$", "")).where(F.contains("line", F.lit(":")))
    told = told.select("host", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    by = W.partitionBy("host").orderBy("at")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(by), F.lit("")) != "user-agent")
    return told.withColumn("opens", opens).withColumn("grp", F.sum(F.col("opens").cast("int")).over(by)).drop("opens")


def rules_for(texts: DataFrame, agent: str) -> DataFrame:
    """host, pattern, allow: the rules that hold for an agent.

    Of the groups whose agent stands in its name that with the longest counts, the first of equally long ones; else the first
    group for '*'; else the host has no rules.
    """
    own = lines(texts.select("host", "text"))
    name = F.lower("value")
    fits = own.where("key = 'user-agent' AND grp > 0").where((name == "*") | F.contains(F.lit(agent.lower()), name) & (name != ""))
    rank = F.struct(F.when(name == "*", 0).otherwise(F.length(name)).alias("n"), (-F.col("at")).alias("at"))
    chosen = fits.groupBy("host").agg(F.max_by("grp", rank).alias("grp"))
    rules = own.where("key IN ('allow', 'disallow')").join(chosen, ["host", "grp"])
    return rules.select("host", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow"))


def unquoted(text: Column) -> Column:
    """Percent escapes as characters; a '%' that begins none stays, and so does '+'."""
    escaped = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(text, F.lit("%")), F.url_decode(escaped)).otherwise(text)


def path_of(url: Column) -> Column:
    """Path, '/' if there is none, and query of a URL; a text without a scheme is a path."""
    rest = F.regexp_replace(url, r"#.*$", "")
    path, query = F.regexp_extract(rest, r"^[^:/?]+://[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.when(F.regexp_like(rest, F.lit(r"^[^:/?]+://")), F.concat(F.when(path == "", "/").otherwise(path), query)).otherwise(rest)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?]+://([^/?#]*)", 1))


def _regex(pattern: Column) -> Column:
    """'*' stands for anything and a last '$' for the end; all else for itself."""
    bare = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.concat(F.lit(r"^\Q"), F.replace(F.replace(bare, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    return F.concat(quoted, F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))


def verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, allowed, rule of pages (page_id, url): the longest pattern that fits wins, allow on a tie; none allows, and its rule is null.

    rules: pattern, allow and host, or no host if they hold for all. A host's rules are sorted into one list, longest first, so a page
    meets one row, and the first that fits decides. An empty pattern fits nothing. Paths and patterns are compared without percent escapes. A null URL has
    no rule.
    """
    keyed = "host" in rules.columns
    text = unquoted(F.col("pattern"))
    plain = ~F.contains(text, F.lit("*")) & ~F.endswith(text, F.lit("$"))
    rule = F.struct((-F.length("pattern")).alias("n"), (~F.col("allow")).alias("deny"), "pattern", plain.alias("plain"), F.when(plain, text).otherwise(_regex(text)).alias("test"))
    rows = rules.where("pattern <> ''").withColumn("rule", rule)
    lists = rows.groupBy(F.lower("host").alias("host")).agg(F.sort_array(F.collect_set("rule")).alias("rules")) if keyed else rows.agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    asked = pages.select("page_id", host_of(F.col("url")).alias("host"), unquoted(path_of(F.col("url"))).alias("path"))
    met = asked.join(lists, "host", "left") if keyed else asked.crossJoin(F.broadcast(lists))
    first = F.get(F.filter("rules", lambda r: F.when(r["plain"], F.startswith("path", r["test"])).otherwise(F.regexp_like("path", r["test"]))), F.lit(0))
    return met.select("page_id", F.coalesce(~first["deny"], F.lit(True)).alias("allowed"), first["pattern"].alias("rule"))
