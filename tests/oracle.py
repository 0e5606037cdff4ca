"""Holding a Spark result against DuckDB's result of the same query."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "tzinfo") and x.tzinfo:
        return x.replace(tzinfo=None)
    return x


def rows_of(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def connection(sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 4")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def difference(df, sql: str, con) -> str:
    """What differs, or an empty string."""
    found = con.execute(sql)
    names, kinds = [c[0] for c in found.description], {c[0]: str(c[1]) for c in found.description}
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, wanted {sorted(names)}"
    odd = [f"{c} is {kind}, wanted {kinds[c]}" for c, kind in df.dtypes if _TYPES.get(kind, kinds[c]) != kinds[c]]
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        odd.append(f"{len(got)} rows, wanted {len(want)}; only here {extra}; only there {missing}"[:1500])
    return "; ".join(odd)
