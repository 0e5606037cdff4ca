"""A table of a database, read by ranges of its key in pages of bounded size.

The format "keyset" reads over any DB-API module. The driver walks the key in steps of `range_rows` rows and keeps the
bounds only; each range is one partition, whose task asks for pages of `page_rows` rows, each after the last key of the
page before, so neither side ever holds or skips more than a page. A range that is read again gives the same rows, so a
lost executor costs its own ranges only. As a stream, the offset is the last key that was read: a query that starts again from its
checkpoint goes on behind it.

The key must be unique and not null: a page that would cut between equal keys, or a null key, is an error, as rows could
be lost. A stream sees rows with keys above those it has read; a key that is added below them is not read. An empty table
gives no rows. Nulls in other columns stay null. With the option push_filters, comparisons of the key with a constant go
to the database, which needs spark.sql.python.filterPushdown.enabled; without it Spark applies them.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a partition, and of a page.
RANGE_ROWS, PAGE_ROWS = 100_000, 5_000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class KeyRange(InputPartition):
    """Keys above `after` (None: from the first on) up to `upto`."""

    after: Any
    upto: Any


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Table:
    """One table behind a connection that each call opens for itself."""

    def __init__(self, options: dict[str, str], schema: StructType):
        missing = [o for o in ("connect", "target", "table", "key") if o not in options]
        if missing:
            raise ValueError(f"options {', '.join(missing)} must be set")
        module, _, name = options["connect"].partition(":")
        self.module, self.name, self.target, self.mark = module, name or "connect", options["target"], options.get("placeholder", "?")
        self.table, self.key = quoted(options["table"]), quoted(options["key"])
        self.range_rows, self.page_rows = int(options.get("range_rows", RANGE_ROWS)), int(options.get("page_rows", PAGE_ROWS))
        if self.range_rows < 1 or self.page_rows < 1:
            raise ValueError("range_rows and page_rows must be positive")
        self.schema = to_arrow_schema(schema)
        self.bounds: list[tuple[str, Any]] = []

    def opened(self):
        return closing(getattr(importlib.import_module(self.module), self.name)(self.target))

    def ask(self, connection, what: str, bounds: list[tuple[str, Any]], tail: str = "") -> list[tuple]:
        where = " AND ".join([f"{self.key} {sign} {self.mark}" for sign, _ in bounds] or ["1 = 1"])
        cursor = connection.cursor()
        cursor.execute(f"SELECT {what} FROM {self.table} WHERE {where} {tail}", [value for _, value in bounds])
        return cursor.fetchall()

    def last(self) -> Any:
        """The greatest key; None for an empty table."""
        with self.opened() as connection:
            return self.ask(connection, f"max({self.key})", self.bounds)[0][0]

    def ranges(self, after: Any = None, upto: Any = None) -> list[KeyRange]:
        """Ranges of range_rows rows each, found by one step over the key's index for each."""
        found: list[KeyRange] = []
        upper = [("<=", upto)] if upto is not None else []
        with self.opened() as connection:
            cursor = connection.cursor()
            cursor.execute(f"SELECT 1 FROM {self.table} WHERE {self.key} IS NULL LIMIT 1")
            if cursor.fetchall():
                raise ValueError(f"{self.table} holds a row whose key {self.key} is null")
            while True:
                lower = [(">", after)] if after is not None else []
                bounds = self.bounds + lower + upper
                step = self.ask(connection, self.key, bounds, f"ORDER BY {self.key} LIMIT 1 OFFSET {self.range_rows - 1}")
                end = step[0][0] if step else self.ask(connection, f"max({self.key})", bounds)[0][0]
                if end is None:
                    return found
                found.append(KeyRange(after, end))
                if not step:
                    return found
                after = end

    def pages(self, own: KeyRange) -> Iterator[pa.RecordBatch]:
        columns = ", ".join([self.key, *map(quoted, self.schema.names)])
        after = own.after
        with self.opened() as connection:
            while True:
                bounds = self.bounds + ([(">", after)] if after is not None else []) + [("<=", own.upto)]
                rows = self.ask(connection, columns, bounds, f"ORDER BY {self.key} LIMIT {self.page_rows + 1}")
                more = len(rows) > self.page_rows
                if more and rows[-1][0] == rows[-2][0]:
                    raise ValueError(f"{self.table} holds {rows[-1][0]!r} more than once as its key {self.key}")
                rows = rows[: self.page_rows]
                if rows:
                    after = rows[-1][0]
                    values = list(zip(*rows, strict=True))[1:]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)
                if not more:
                    return


class KeysetReader(DataSourceReader):
    def __init__(self, table: Table, key: str):
        self.table, self.key = table, key

    def partitions(self) -> list[KeyRange]:
        # An empty list would stand for one partition without bounds.
        return self.table.ranges() or [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        return self.table.pages(partition) if partition.upto is not None else iter(())


class FilteringReader(KeysetReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _SIGNS and f.attribute == (self.key,) and f.value is not None:
                self.table.bounds.append((_SIGNS[type(f)], f.value))
            else:
                yield f


class KeysetStream(DataSourceStreamReader):
    def __init__(self, table: Table):
        self.table, self.reached = table, None

    def initialOffset(self) -> dict:
        return {"key": None}

    def latestOffset(self) -> dict:
        # Keys that have gone from the table's end don't move the offset back.
        last = self.table.last()
        if last is not None and (self.reached is None or last > self.reached):
            self.reached = last
        return {"key": self.reached}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        if end["key"] is None or start["key"] == end["key"]:
            return [KeyRange(None, None)]
        return self.table.ranges(start["key"], end["key"]) or [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        return self.table.pages(partition) if partition.upto is not None else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


class KeysetSource(DataSource):
    """spark.dataSource.register(KeysetSource), then spark.read.format("keyset") or spark.readStream with a schema and these options.

    connect: module of the DB-API, or module:function; target: its argument; table; key; range_rows; page_rows; push_filters;
    placeholder: how the module marks parameters (? or %s).
    """

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("keyset needs the schema of the columns to read")

    def reader(self, schema: StructType) -> KeysetReader:
        # Spark refuses a reader that takes filters where its setting is off.
        kind = FilteringReader if self.options.get("push_filters", "false").lower() == "true" else KeysetReader
        return kind(Table(dict(self.options), schema), self.options["key"])

    def streamReader(self, schema: StructType) -> KeysetStream:
        return KeysetStream(Table(dict(self.options), schema))
