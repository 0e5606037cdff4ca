"""Guards, plans of what to collect, audits of decisions, resets, and texts that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.text import csv_field
from shelfmark.operators.lifecycle import decided, orphan_books

#: Words in a picture's address that tell that it is no cover; own vocabulary.
NO_COVER = ["logo", "banner", "icon", "header", "footer", "sprite", "blank"]


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, column) of what is required and not there."""
    return [(t, c) for t, columns in required.items() for c in columns if t not in tables or c not in tables[t].columns]


def guard_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> None:
    """Raises before a run if a required column is missing."""
    if lost := missing_columns(tables, required):
        raise ValueError("missing columns: " + ", ".join(f"{t}.{c}" for t, c in lost))


def collection_tasks(sources: DataFrame, categories: DataFrame, branches: DataFrame) -> DataFrame:
    """source, branch, code, url, pages: what to fetch for each enabled category, in each enabled branch if a source has some.

    sources: source, url (with {branch} and {code}), page_size; categories: source, code, max_items, enabled; branches:
    source, branch, enabled. Pages are rounded up.
    """
    on = sources.join(categories.where("enabled").select("source", "code", "max_items"), "source")
    at = branches.where("enabled").select("source", "branch")
    known = branches.select("source").distinct()
    each = on.join(known, "source", "left_anti").withColumn("branch", F.lit(None).cast("string")).unionByName(on.join(at, "source"))
    url = F.replace(F.replace("url", F.lit("{branch}"), F.coalesce("branch", F.lit(""))), F.lit("{code}"), F.col("code"))
    return each.select("source", "branch", "code", url.alias("url"), F.ceil(F.col("max_items") / F.col("page_size")).cast("int").alias("pages"))


def history_lines(history: DataFrame) -> DataFrame:
    """book_id, n, line: a book's history as CSV, in order of date, store, period and list; line 0 is the header."""
    fields = ["snapshot_date", "store_id", "period", "unified", "rank", "sales_point"]
    line = F.concat_ws(",", *(csv_field(F.col(c).cast("string")) for c in fields))
    rows = history.select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("snapshot_date", "store_id", "period", "unified")).alias("n"), line.alias("line"))
    head = history.select("book_id").distinct().select("book_id", F.lit(0).alias("n"), F.lit(",".join(fields)).alias("line"))
    return head.unionByName(rows)


def name_figures(combined: DataFrame, books: DataFrame, name: Column, everywhere: int = 3) -> DataFrame:
    """name, books, best, in_all_stores, stores: figures of a publisher's or author's page."""
    own = combined.join(books, "book_id").withColumn("name", name).where("name IS NOT NULL AND name <> ''")
    return own.groupBy("name").agg(F.count("*").alias("books"), F.min("avg_rank").alias("best"), F.count_if(F.col("store_count") >= everywhere).alias("in_all_stores"), F.sum("store_count").alias("stores"))


def collated(rows: DataFrame, within: list[str], by: str, key: str, locale: str = "ko") -> DataFrame:
    """Rows numbered within `within` in a language's order of `by`, then by key."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*within).orderBy(F.collate(F.col(by), locale), key)))


def share_token() -> Column:
    """Two random UUIDs without dashes."""
    return F.replace(F.concat(F.expr("uuid()"), F.expr("uuid()")), F.lit("-"), F.lit(""))


def _inside(text: Column) -> Column:
    found = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    return F.when(found != "", found).otherwise(text)


def _percent(text: Column) -> Column:
    number = _inside(text).try_cast("double")
    return F.when(number.isNotNull(), F.concat(F.round(number * 100).cast("int").cast("string"), F.lit("%"))).otherwise(_inside(text))


def reason_labels(title_sim: Column, author: Column, publisher: Column, month: Column, isbn: Column, rejected_by: Column) -> Column:
    """array of struct(label, tone): why a pair was matched or not; tone is good, plain or bad. Null reasons say nothing.

    author, publisher: exact, missing, similar(x), different(x); month: exact, missing, near(x), different(x).
    """
    said = lambda label, tone: F.struct(label.alias("label"), tone.alias("tone"))
    word = F.lit
    out = [F.when(title_sim.isNotNull(), said(F.concat(word("title "), F.round(title_sim * 100).cast("int").cast("string"), word("% alike")), F.when(title_sim >= 0.9, "good").when(title_sim >= 0.75, "plain").otherwise("bad")))]
    for name, c in (("author", author), ("publisher", publisher)):
        label = (F.when(c == "exact", word(f"{name} equal")).when(c == "missing", word(f"{name} missing on one side")).when(F.startswith(c, word("similar")), F.concat(word(f"{name} similar "), _percent(c)))
                 .when(F.startswith(c, word("different")), F.concat(word(f"{name} different "), _percent(c))).otherwise(F.concat(word(f"{name} "), c)))
        out.append(F.when(c.isNotNull(), said(label, F.when(c == "exact", "good").when(F.startswith(c, word("different")), "bad").otherwise("plain"))))
    far = F.startswith(month, word("near")) | F.startswith(month, word("different"))
    label = F.when(month == "exact", word("month equal")).when(month == "missing", word("month missing on one side")).when(far, F.concat(word("months apart: "), _inside(month))).otherwise(F.concat(word("month "), month))
    out.append(F.when(month.isNotNull(), said(label, F.when(month == "exact", "good").when(F.startswith(month, word("different")), "bad").otherwise("plain"))))
    out.append(F.when(isbn == "exact", said(word("ISBN equal"), word("good"))))
    out.append(F.when(rejected_by.isNotNull(), said(F.concat(word("rejected by "), rejected_by), word("bad"))))
    return F.array_compact(F.array(*out))


def decision_audit(decisions: DataFrame, zone: str = "Asia/Seoul", days: int = 5) -> DataFrame:
    """item, value: how many decisions of each kind, by whom, when, and which can be undone; then the busiest days.

    decisions: decision, decided_by, decided_at, auto_decision. Only decisions by hand count.
    """
    own = decisions.where(F.col("decision").isin("manual_merge", "manual_split"))
    at = lambda c: F.coalesce(F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd HH:mm"), F.lit("none"))
    one = own.agg(
        F.count_if(F.col("decision") == "manual_merge").cast("string").alias("merges"), F.count_if(F.col("decision") == "manual_split").cast("string").alias("splits"),
        F.count("decided_by").cast("string").alias("by_someone"), F.count_if(F.col("decided_by").isNull()).cast("string").alias("by_nobody"), F.countDistinct("decided_by").cast("string").alias("deciders"),
        F.count_if(F.col("auto_decision").isNull()).cast("string").alias("final"), F.count("auto_decision").cast("string").alias("can_be_undone"),
        at(F.min("decided_at")).alias("first"), at(F.max("decided_at")).alias("last"), F.count_if(F.col("decided_at").isNull()).cast("string").alias("without_time"))
    figures = one.unpivot([], one.columns, "item", "value")
    by_day = own.where("decided_at IS NOT NULL").groupBy(F.to_date(F.from_utc_timestamp("decided_at", zone)).alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(days)
    return figures.unionByName(by_day.select(F.concat(F.lit("day "), F.col("day").cast("string")).alias("item"), F.col("n").cast("string").alias("value")))


def trim_chain(rankings: DataFrame, items: DataFrame, matches: DataFrame, books: DataFrame, depths: dict[str, int], by_kind: dict[str, int], otherwise: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """List rows beyond their category's depth (else their kind's), then items left without a rank and not decided by a
    person, then books left without an item: what goes in each step."""
    depth = F.lit(otherwise)
    for column, most in (("kind", by_kind), ("unified", depths)):
        for value, n in most.items():
            depth = F.when(F.col(column) == value, F.lit(n)).otherwise(depth)
    gone, kept = rankings.where(F.col("rank") > depth), rankings.where(F.col("rank") <= depth)
    stay = kept.select("store_book_id").union(decided(matches)).distinct()
    return gone, items.join(stay, "store_book_id", "left_anti"), orphan_books(books, items.join(stay, "store_book_id", "left_semi"))


def same_decisions(before: DataFrame, after: DataFrame) -> None:
    """Raises if a step that may not touch decisions by hand changed how many there are of a kind."""
    count = lambda df: {r.decision: r["count"] for r in df.where(F.col("decision").startswith("manual")).groupBy("decision").count().collect()}
    if (old := count(before)) != (new := count(after)):
        raise ValueError(f"decisions by hand changed from {old} to {new}")


def reset_to(rankings: DataFrame, items: DataFrame, books: DataFrame, categories: DataFrame, keep: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stays if only one date is kept: its rows, items in a list, books with an item, and categories that are on or used.

    Raises if that date has no row, so that a wrong date deletes nothing.
    """
    rows = rankings.where(F.col("snapshot_date") == F.lit(keep).cast("date"))
    if rows.limit(1).count() == 0:
        raise ValueError(f"no list of {keep}")
    used = items.join(rows.select("store_book_id").distinct(), "store_book_id", "left_semi")
    linked = books.join(used.where("book_id IS NOT NULL").select("book_id").distinct(), "book_id", "left_semi")
    listed = rows.select("unified", "kind").distinct().withColumn("_used", F.lit(True))
    alive = categories.join(listed, ["unified", "kind"], "left").where(F.col("enabled") | F.col("_used").isNotNull()).drop("_used")
    return rows, used, linked, alive


def digest_lines(changes: DataFrame, known_before: bool) -> DataFrame:
    """n, line: a combined list as text, a line for each place, with how it moved.

    changes: position, old_position, title, author, publisher, pub_ym.
    """
    moved = F.col("old_position") - F.col("position")
    told = F.when(F.lit(not known_before), "unknown").when(F.col("old_position").isNull(), "new").when(moved == 0, "same").otherwise(F.format_string("%+d", moved))
    line = F.format_string("%3d. %s / %s / %s / %s [%s]", F.col("position"), F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("publisher", F.lit("")), F.coalesce("pub_ym", F.lit("month unknown")), told)
    return changes.select(F.col("position").alias("n"), line.alias("line"))


def shortened(text: Column, most: int = 1500) -> Column:
    """A report's text, cut behind `most` characters, and saying so."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("\n(cut here)"))).otherwise(text)


def page_probes(pages: DataFrame) -> DataFrame:
    """page_id, covers, letters, has_price, has_isbn, has_data: what a page seems to hold, and whether its text is there at
    all (few letters: it is drawn by scripts). covers: pictures that aren't parts of the site's frame."""
    pictures = F.regexp_extract_all("html", F.lit(r'<img[^>]* src="([^"]+)"'), F.lit(1))
    covers = F.array_distinct(F.filter(pictures, lambda x: ~F.regexp_like(F.lower(x), F.lit("|".join(NO_COVER)))))
    bare = F.regexp_replace("html", r"(?s)<[^>]*>", "")
    return pages.select(
        "page_id", F.coalesce(F.size(covers), F.lit(0)).cast("long").alias("covers"), F.length(F.regexp_replace(bare, r"[^\p{L}]", "")).cast("long").alias("letters"),
        F.regexp_like("html", F.lit(r"\d[\d,]{2,} ?(?:won|USD|EUR)|[$€]\d")).alias("has_price"), F.regexp_like("html", F.lit(r"97[89][0-9]{10}")).alias("has_isbn"), F.regexp_like("html", F.lit("application/ld\\+json|__NEXT_DATA__")).alias("has_data"))


def method_histogram(items: DataFrame, method: Column) -> DataFrame:
    """store_id, method, n, percent: by which way items of a store got a value."""
    counted = items.groupBy("store_id", method.alias("method")).agg(F.count("*").alias("n"))
    total = counted.groupBy("store_id").agg(F.sum("n").alias("total"))
    return counted.join(total, "store_id").select("store_id", "method", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent"))
