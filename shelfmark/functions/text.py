"""Normalisation of titles, names, dates, prices and numbers as Column expressions, and NFKC as an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Edition words that are taken from titles, each with what it is called; own vocabulary.
EDITIONS = {w: w for w in ("deluxe", "expanded", "illustrated", "limited", "revised", "special")} | {"deluxe box": "boxed", "fully revised": "revised"}
#: Marketing words that are stripped from a title's head.
BADGES = ["new", "hot", "best", "sale"]
#: Corporate words that are no part of a publisher's name, the longest first.
CORPORATE = ["publishing", "publishers", "press", "books", "inc", "ltd"]
#: Words before an amount that tell that it is no price, and words behind one that make it a condition; own vocabulary.
PROMOTION = ["points", "coupon", "mileage", "gift", "delivery", "event", "benefit", "voucher"]
CONDITION = ["or more", "or less", "or over", "within", "under", "from"]
_BRACKETS = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation, for which there is no built-in function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(text: Column) -> Column:
    """Text in the compatibility normal form; what is ASCII only is so already, and does not go through Python."""
    return F.coalesce(nfkc(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)), text)


def brackets(text: Column) -> Column:
    """What stands in brackets, without them."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_BRACKETS})"), 1), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def without_brackets(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BRACKETS, " "))


def subtitle(text: Column) -> Column:
    """What follows the first spaced dash or colon behind at least two characters, else null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"^.{2,}?(?: - |: )(.*)$", 1)), F.lit(""))


def without_subtitle(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^(.{2,}?)(?: - |: ).*$", "$1"))


def _words(names) -> str:
    """A pattern for whole words, the longest first, so that what a longer one takes is not found again in it."""
    return rf"\b(?:{'|'.join(sorted(names, key=lambda w: (-len(w), w)))})\b"


def editions(text: Column, names: dict[str, str] | None = None) -> Column:
    """What the edition words in a text are called, sorted; with 'all volumes' for 'all n vols' and 'set' for the word set.

    names: word and what it is called. Words are whole ones, and the leftmost and longest takes its letters: those of 'deluxe box' are no 'deluxe'.
    """
    names = EDITIONS if names is None else names
    low = F.lower(text)
    called = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    found = F.transform(F.regexp_extract_all(low, F.lit(_words(names)), F.lit(0)), lambda w: called[w])
    marks = F.array(F.when(F.regexp_like(low, F.lit(r"\ball \d+ vols?\b")), "all volumes"), F.when(F.regexp_like(low, F.lit(r"\bset\b")), "set"))
    return F.array_sort(F.array_distinct(F.concat(found, F.array_compact(marks))))


def set_volumes(text: Column) -> Column:
    """n of 'all n vols' or 'set of n'."""
    found = F.regexp_extract(F.lower(text), r"(?:all|set of) (\d+)", 1)
    return F.when(F.length(found).between(1, 9), found.cast("int"))


def volume_number(text: Column) -> Column:
    """1 to 200: a marked number, else one that stands alone but not first, else one that ends a word."""
    low = F.regexp_replace(F.lower(text), r"(?:all|set of) \d+(?: vols)?", " ")
    found = [F.regexp_extract(low, p, 1) for p in (r"\b(?:vol|volume|no)\.? ?(\d{1,3})\b", r"\S\s+(\d{1,3})(?:\s|$)", r"\pL(\d{1,3})$")]
    first = F.coalesce(*(F.nullif(x, F.lit("")) for x in found)).cast("int")
    return F.when(first.between(1, 200), first)


def without_badges(text: Column, times: int = 3) -> Column:
    """Leading badge words, with or without '!', stripped repeatedly."""
    for _ in range(times):
        text = F.regexp_replace(text, rf"^(?i)(?:{'|'.join(BADGES)})!?\s+", "")
    return text


def letters(text: Column, also: str = "") -> Column:
    """Lower-case letters and digits, and the marks in `also`, only; null if none are left."""
    return F.nullif(F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{also}]+", "")), F.lit(""))


def normalize_title(text: Column) -> Column:
    """struct(core, subtitle, editions, set_volumes)."""
    whole = without_badges(F.trim(compatible(text)))
    bare = without_brackets(whole)
    core = F.regexp_replace(F.lower(without_subtitle(bare)), _words([*EDITIONS, "edition"]), " ")
    core = F.regexp_replace(core, r"\ball \d+ vols?\b|\bset(?: of \d+)?\b", " ")
    return F.struct(letters(core).alias("core"), letters(subtitle(bare)).alias("subtitle"), editions(whole).alias("editions"), set_volumes(whole).alias("set_volumes"))


def normalize_publisher(text: Column) -> Column:
    """Without corporate words, blanks and marks, but with what stands in brackets, which may be another name of the house."""
    return letters(F.regexp_replace(F.lower(compatible(text)), rf"{_words(CORPORATE)}\.?", " "), r"()\[\]{}")


def normalize_author(text: Column) -> Column:
    return letters(F.regexp_replace(F.lower(without_brackets(compatible(text))), r"\b(?:author|editor|translator|by)\b", " "))


def fold(text: Column) -> Column:
    """Accented Latin letters without their marks."""
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")


def parse_number(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.length(digits).between(1, 18), digits.cast("long"))


def parse_year_month(text: Column) -> Column:
    """'YYYY-MM' of a text with a year and a month."""
    year, month = (F.regexp_extract(text, r"(\d{4})\D{1,3}(\d{1,2})", k) for k in (1, 2))
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def parse_prices(text: Column, currency: str = "won", low: int = 1000, high: int | None = 2_000_000, before: int = 14) -> Column:
    """struct(list_price, sale_price): the larger and the smaller of the first two amounts. One amount is the list price, and no sale price.

    Amounts that a condition ('or more') follows, that a word of PROMOTION stands within `before` characters before, or that
    lie outside low to high (None: no upper bound), are no prices.
    """
    promotion = "|".join(rf"{w}[\s\S]{{0,{before - len(w)}}}" for w in PROMOTION)
    after = "|".join(CONDITION)
    found = F.regexp_extract_all(text, F.lit(rf"((?<![\d,])(?<!{promotion})\d[\d,]{{0,12}} ?{currency}(?!\s*(?:{after})))"), 1)
    amounts = F.transform(found, lambda x: F.regexp_replace(x, r"[^0-9]", "").cast("long"))
    two = F.slice(F.filter(amounts, lambda x: (x >= low) & (x <= high if high is not None else F.lit(True))), 1, 2)
    return F.struct(F.array_max(two).alias("list_price"), F.when(F.size(two) == 2, F.array_min(two)).alias("sale_price"))


def role_author(names: Column, roles: list[str]) -> Column:
    """From an array of struct(name, role) the name whose role comes first in roles, else the first name."""
    order = F.create_map(*(x for k, r in enumerate(roles) for x in (F.lit(r), F.lit(k))))
    ranked = F.transform(names, lambda x, i: F.struct(F.coalesce(order.getItem(x["role"]), F.lit(len(roles))).alias("o"), i.alias("i"), x["name"].alias("name")))
    return F.array_min(ranked)["name"]


def isbn13_digit(first12: Column) -> Column:
    """The check digit of twelve digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(first12, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return (F.lit(10) - total % 10) % 10


def is_isbn13(text: Column) -> Column:
    bare = F.regexp_replace(text, "[- ]", "")
    ok = F.regexp_like(bare, F.lit(r"^97[89]\d{10}$"))
    return F.when(ok, isbn13_digit(bare) == F.substring(bare, 13, 1).cast("int")).otherwise(F.lit(False))


def is_isbn10(text: Column) -> Column:
    bare = F.upper(F.regexp_replace(text, "[- ]", ""))
    value = lambda i: F.when(F.substring(bare, i, F.lit(1)) == "X", 10).otherwise(F.substring(bare, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: value(i) * (F.lit(11) - i)), F.lit(0), lambda a, x: a + x)
    return F.when(F.regexp_like(bare, F.lit(r"^\d{9}[\dX]$")), total % 11 == 0).otherwise(F.lit(False))


def isbn10_to_13(text: Column) -> Column:
    """The thirteen digits of a valid ISBN-10, else null."""
    first = F.concat(F.lit("978"), F.substring(F.regexp_replace(text, "[- ]", ""), 1, 9))
    return F.when(is_isbn10(text), F.concat(first, isbn13_digit(first).cast("string")))


def isbn_in(text: Column) -> Column:
    """The first ISBN-13 in a text whose check digit is right; it may hold dashes, and no digit may touch it."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(97[89](?:-?\d){10})(?!\d)"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: F.replace(x, F.lit("-"), F.lit(""))), is_isbn13), F.lit(0))


def _thirteen(number: Column) -> Column:
    """The ISBN-13 that thirteen or ten signs stand for, null if the check digit is wrong."""
    return F.when(F.length(number) == 10, isbn10_to_13(number)).when(_digits_check(number), number)


def _digits_check(number: Column) -> Column:
    return F.regexp_like(number, F.lit(r"^\d{13}$")) & (isbn13_digit(number) == F.substring(number, 13, 1).cast("int"))


def isbn_in_address(text: Column) -> Column:
    """struct(isbn13, method) of the first number in an address whose check digit is right: thirteen digits, else ten signs that no digit touches."""
    long = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"(\d{13})"), F.lit(1)), _digits_check), F.lit(0))
    short = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{9}[\dXx])(?!\d)"), F.lit(1)), isbn10_to_13), lambda x: x.isNotNull()), F.lit(0))
    return F.struct(F.coalesce(long, short).alias("isbn13"), F.when(long.isNotNull(), "thirteen").when(short.isNotNull(), "ten").alias("method"))


def isbn_hits(text: Column, around: int = 70, told: int = 40) -> Column:
    """array of struct(isbn13, context): every number of thirteen digits or ten signs in a text whose check digit is right.

    No digit or dash may touch it. Ten signs are told as thirteen. context: `around` characters on both sides, blanks as one. Of hits with
    one number and the same first `told` characters of context the first counts.
    """
    pattern = r"(?<![\d-])(?:\d{13}|\d{9}[\dXx])(?![\d-])"
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern), lambda x: F.length(x))
    n = F.size(found)
    # Where each begins: behind all that stands between and all numbers before it.
    begins = F.aggregate(
        F.slice(F.arrays_zip(found.alias("f"), between.alias("b")), F.lit(1), F.greatest(n, F.lit(0))), F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<raw:string,begin:int>>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["b"] + F.length(x["f"])).alias("at"), F.concat(s["out"], F.array(F.struct(x["f"].alias("raw"), (s["at"] + x["b"]).alias("begin")))).alias("out")), lambda s: s["out"])
    begin = lambda x: F.greatest(x["begin"] - around, F.lit(1))
    context = lambda x: F.trim(F.regexp_replace(F.substring(text, begin(x), x["begin"] - begin(x) + F.length(x["raw"]) + around), r"\s+", " "))
    hits = F.filter(F.transform(begins, lambda x: F.struct(_thirteen(x["raw"]).alias("isbn13"), context(x).alias("context"))), lambda x: x["isbn13"].isNotNull())
    key = lambda x: F.struct(x["isbn13"], F.left(x["context"], F.lit(told)))
    return F.filter(hits, lambda x, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda y: key(y) == key(x)))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    """The two largest units of a time: '2 d 3 h', '4 min 5 s'; null for null or negative."""
    units = (("d", 86400), ("h", 3600), ("min", 60), ("s", 1))
    out = None
    for (big, n), (small, m) in reversed(list(zip(units, units[1:], strict=False))):
        text = F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {big} "), F.floor(seconds % n / m).cast("string"), F.lit(f" {small}"))
        out = F.when(seconds >= n, text).otherwise(F.concat(seconds.cast("long").cast("string"), F.lit(" s")) if out is None else out)
    return F.when(seconds >= 0, out)


def ago(at: Column, now: Column) -> Column:
    """How long before now, in one unit; 'just now' below a minute and in the future."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    told = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s.isNull(), None).when(s < 60, "just now").when(s < 3600, told(60, "min")).when(s < 86400, told(3600, "h")).otherwise(told(86400, "d"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a text of one character is its own pair."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).when(n == 1, F.array(text)).otherwise(F.array().cast("array<string>"))


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays of bigrams; 0 if both are empty."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, quote or line end; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.regexp_like(text, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def file_name(text: Column) -> Column:
    """Letters, digits, dot, dash and underscore only."""
    return F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}._-]+", "_")


def day_label(day: Column) -> Column:
    return F.date_format(day, "MM-dd (E)")


def local_date(at: Column, zone: str = "Asia/Seoul") -> Column:
    """The calendar day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))
