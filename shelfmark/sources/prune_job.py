"""Rows that leave a folder of tables for an archive: export, verify, delete, in steps that can be taken again.

A run has a folder of its own, and each step's result there is its record: a step whose result is complete is not taken
again, one that was cut off is. What is to go is fixed by the first step, so a later attempt deletes what was exported and
nothing else. Nothing is deleted before the export was read back. Rows that stay in a partition which loses some are written aside
first; only then is the partition replaced, from there, so an attempt that was cut off in between loses and repeats nothing.

Writers of the partitions that a run touches wait until it is done.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.sources import archive

#: Group of all rows where none is named.
ALL = "all"


class Leaving(NamedTuple):
    """A table of the folder: its schema, the column it is partitioned by, and the keys (further columns of it) that go."""

    schema: StructType
    part: str
    keys: DataFrame


class Run:
    """A run of a job over the tables in `root`. name: that of its folder; the same name takes up an earlier attempt.

    tables: by name, in the order in which they are deleted from. group: a column of all keys; rows of a group go only if all
    tables' rows of it are found intact, without one all rows are one group. Null keys name no row and are left out.
    at: called with the name of each point that is passed.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, tables: dict[str, Leaving], group: str | None = None, at: Callable[[str], None] = lambda point: None):
        self.spark, self.root, self.tables, self.group, self.at = spark, root.rstrip("/"), tables, group, at
        self.folder = f"{self.root}/_runs/{name}"

    def _path(self, text: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(text)) if ":" in text else jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, step: str) -> bool:
        path, system = self._path(f"{self.folder}/{step}/_SUCCESS")
        return system.exists(path)

    def _once(self, step: str, make: Callable[[], DataFrame], by: str | None = None) -> None:
        """Write what a step gives, unless that is there."""
        if not self._complete(step):
            self.at(f"before {step}")
            writer = make().write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{step}")
            self.at(f"after {step}")

    def _result(self, step: str, schema: StructType | str | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(f"{self.folder}/{step}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.tables[name].schema).parquet(f"{self.root}/{name}")

    def _plan(self, name: str) -> None:
        keys = self.tables[name].keys
        keys = keys.dropna().distinct().withColumn("_group", F.col(self.group).cast("string") if self.group else F.lit(ALL))
        self._once(f"plan-{name}", lambda: keys)

    def _keys(self, name: str) -> list[str]:
        return self.tables[name].keys.columns

    def _export(self, name: str) -> None:
        """The rows that the plan names, as an archive by group; the manifest is written last."""
        def rows():
            return self.table(name).join(self._result(f"plan-{name}"), self._keys(name)).select(*self.tables[name].schema.names, "_group")

        self._once(f"manifest-{name}", lambda: archive.write_archive(rows(), "_group", f"{self.folder}/export/{name}"))

    def _check(self, name: str) -> None:
        """day (the group), rows, intact: the export read back holds what was exported, and a row for each key."""
        def checks():
            found = archive.verified(self.spark, f"{self.folder}/export/{name}", self._result(f"manifest-{name}"))
            planned = self._result(f"plan-{name}")
            without = planned.join(self.table(name).select(*self._keys(name)).distinct(), self._keys(name), "left_anti").select(F.col("_group").alias("day")).distinct()
            found = found.join(without.withColumn("_lost", F.lit(True)), "day", "full_outer")
            return found.select("day", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("intact", F.lit(False)) & F.col("_lost").isNull()).alias("intact"))

        self._once(f"check-{name}", checks)

    def _intact(self) -> DataFrame:
        """_group: those of which no table has a row that is not intact."""
        checks = None
        for name in self.tables:
            own = self._result(f"check-{name}").select("day", "intact")
            checks = own if checks is None else checks.unionByName(own)
        return checks.groupBy(F.col("day").alias("_group")).agg(F.bool_and("intact").alias("ok")).where("ok").select("_group")

    def _aside(self, name: str) -> None:
        """The partitions that lose rows, and the rows that stay in them."""
        own, keys = self.tables[name], self._keys(name)
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")
        going = self._result(f"plan-{name}").join(self._intact(), "_group", "left_semi").select(*keys)
        self._once(f"going-{name}", lambda: going)
        going = self._result(f"going-{name}")
        self._once(f"touched-{name}", lambda: self.table(name).select(own.part, *(k for k in keys if k != own.part), folder).join(going, keys, "left_semi").select(own.part, "_folder").distinct())

        def staying():
            # As many values as partitions are touched; the scan opens no other.
            values = [r[0] for r in self._result(f"touched-{name}").select(own.part).distinct().collect()]
            touched = F.col(own.part).isin([v for v in values if v is not None])
            if None in values:
                touched = touched | F.col(own.part).isNull()
            return self.table(name).where(touched).join(going, keys, "left_anti").select(*own.schema.names)

        self._once(f"staying-{name}", staying, own.part)

    def _replace(self, name: str) -> None:
        """Drop the touched partitions and put back what stays in them."""
        if self._complete(f"replaced-{name}"):
            return
        own = self.tables[name]
        for r in self._result(f"touched-{name}").select("_folder").distinct().collect():
            path, system = self._path(r._folder)
            system.delete(path, True)
            self.at(f"dropped from {name}")
        self._result(f"staying-{name}", own.schema).write.mode("append").partitionBy(own.part).parquet(f"{self.root}/{name}")
        self.at(f"put back into {name}")
        self._once(f"replaced-{name}", lambda: self.spark.range(1))

    def finish(self) -> DataFrame:
        """Take every step that is not complete. Returns table, group, rows, deleted."""
        for step in (self._plan, self._export, self._check, self._aside, self._replace):
            for name in self.tables:
                step(name)
        intact, out = self._intact().withColumn("deleted", F.lit(True)), None
        for name in self.tables:
            rows = self._result(f"check-{name}").withColumnRenamed("day", "_group").join(intact, "_group", "left")
            rows = rows.select(F.lit(name).alias("table"), F.col("_group").alias("group"), "rows", F.coalesce("deleted", F.lit(False)).alias("deleted"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def archived(self, name: str) -> DataFrame:
        """The exported rows of a table, whether they were deleted or not."""
        return archive.read_lines(self.spark, f"{self.folder}/export/{name}").select(F.from_json("line", self.tables[name].schema).alias("r")).select("r.*")
