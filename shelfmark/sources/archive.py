"""Archives and dumps: day folders of gzipped JSON lines with a manifest, verified before anything is dropped."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.plans.staging import tasks_for

#: Most days that one restore takes.
RESTORE_DAYS = 31
#: Name of the day's column while rows are dealt.
DAY = "_archive_day"


def _line(df: DataFrame) -> Column:
    """A row as JSON with its keys in order and nulls written out."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def _manifest(lines: DataFrame) -> DataFrame:
    """day, rows, digest: of a day's lines, in any order. The digest adds up two 64-bit hashes of each line."""
    code = F.xxhash64("line").cast("decimal(20,0)")
    twin = F.xxhash64(F.lit(1), "line").cast("decimal(20,0)")  # the line by another seed
    return lines.groupBy("day").agg(F.count("*").alias("rows"), F.concat_ws(":", F.sum(code).cast("string"), F.sum(twin).cast("string")).alias("digest"))


def dealt_lines(df: DataFrame, day: str, files: int) -> DataFrame:
    """day, line: each day dealt over `files` tasks at most, in order in each.

    Rows are dealt and sorted as they are, and become lines behind that, unless they hold types that have no order, or equal values of
    different spellings. The day is a column by then, so that no comparison makes its text anew.
    """
    at, columns, tasks = F.col(day).cast("string"), sorted(df.columns), tasks_for(df.sparkSession)
    if re.search("map<|float|double|variant|collate", df.schema.simpleString()):
        return df.select(at.alias("day"), _line(df).alias("line")).repartition(tasks, "day", F.pmod(F.xxhash64("line"), F.lit(files))).sortWithinPartitions("day", "line")
    dealt = df.withColumn(DAY, at).repartition(tasks, DAY, F.pmod(F.xxhash64(*columns), F.lit(files))).sortWithinPartitions(DAY, *columns)
    return dealt.select(F.col(DAY).alias("day"), _line(df).alias("line"))


def write_archive(df: DataFrame, day: str, path: str, files: int = 4) -> DataFrame:
    """Write df as path/day=.../*.gz, a JSON line for each row, replacing only the days it holds. Returns the manifest.

    A day is dealt over `files` files at most, so that a large one is not one task's; rows are in order in each, so the
    same rows give the same bytes.
    """
    dealt = dealt_lines(df, day, files)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy("day").text(path)
    return _manifest(df.select(F.col(day).cast("string").alias("day"), _line(df).alias("line")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """day, line of an archive; no rows if it has no file."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*/*.gz")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files):
        return spark.createDataFrame([], "day string, line string")
    return spark.read.schema("value string, day string").text(path).select("day", F.col("value").alias("line"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """day, rows, intact: whether the files hold exactly what the manifest says, all or nothing for each day."""
    found = _manifest(read_lines(spark, path)).select("day", F.col("rows").alias("found"), F.col("digest").alias("found_digest"))
    return manifest.join(found, "day", "left").select("day", "rows", F.coalesce((F.col("rows") == F.col("found")) & (F.col("digest") == F.col("found_digest")), F.lit(False)).alias("intact"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """day, digest (sha256), bytes of each file as it was written."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "day=([^/]*)/", 1).alias("day"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def unbroken(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """day, intact: whether a day has exactly the files that it was sealed with, byte for byte."""
    count = lambda df, name: df.groupBy("day", "digest", "bytes").agg(F.count("*").alias(name))
    both = count(sealed, "was").join(count(now, "is"), ["day", "digest", "bytes"], "full_outer")
    return both.groupBy("day").agg(F.bool_and(F.coalesce(F.col("was") == F.col("is"), F.lit(False))).alias("intact"))


def droppable(df: DataFrame, day: str, checks: DataFrame) -> DataFrame:
    """Rows of df that may go, as their day is intact in the archive."""
    intact = checks.where("intact").select(F.col("day").alias("intact_day"))
    return df.join(intact, df[day].cast("string") == intact["intact_day"], "left_semi")


def restored(spark: SparkSession, path: str, schema: str | StructType, first: str, last: str) -> DataFrame:
    """Rows of the days first to last, at most RESTORE_DAYS of them."""
    days = spark.sql(f"SELECT datediff(DATE '{first}', DATE '{last}') AS n").first().n
    if not -RESTORE_DAYS < days <= 0:
        raise ValueError(f"a restore takes 1 to {RESTORE_DAYS} days, not {first} to {last}")
    lines = read_lines(spark, path).where(F.col("day").between(first, last))
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """table, line: many tables in one stream of lines."""
    out = None
    for name, df in tables.items():
        own = df.select(F.lit(name).alias("table"), _line(df).alias("line"))
        out = own if out is None else out.unionByName(own)
    return out


def untagged(lines: DataFrame, name: str, schema: str) -> DataFrame:
    """One table out of such a stream."""
    return lines.where(F.col("table") == name).select(F.from_json("line", schema).alias("r")).select("r.*")


def replace_days(df: DataFrame, day: str, path: str, files: int = 4) -> None:
    """Write df as Parquet by day, a day dealt over `files` files at most; days that it holds are replaced, others stay."""
    df.repartition(day, F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))
