"""Keyed streams against a sequential version, over several batches and a restart."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from shelfmark.streaming import keyed

REQUESTS = "request_id long, user_id long, ts timestamp, hours int"
LOGS = "store_id int, log_id long, snapshot_date date, items int, good boolean, ended boolean"


def fed(spark, folder, schema, batches, query):
    """The rows of a stream that starts anew for each batch of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        keyed.written(query(source), f"{folder}/out", f"{folder}/state")
    # Started again with nothing new: no row is written twice.
    keyed.written(query(source), f"{folder}/out", f"{folder}/state")
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_quota_equals_a_sequential_version(spark, tmp_path):
    draw, start = random.Random(5), dt.datetime(2024, 3, 1)
    # Many at the same time, and some exactly when a grant ends.
    rows = [(n, draw.randrange(3), start + dt.timedelta(minutes=30 * (n // 3)), draw.choice([None, -2, 0, 1, 2, 3, 9])) for n in range(120)]
    live, want = {}, []
    for n, user, ts, hours in rows:
        own = [t for t in live.get(user, []) if t > ts]
        ok = len(own) < 2
        live[user] = own + [ts + dt.timedelta(hours=3 if hours is None else max(1, min(3, hours)))] * ok
        want.append((n, user, ok))
    odd = [(None, 1, start, 1), (500, None, start, 1), (501, 1, None, 1)]
    batches = cut(rows, 3)
    draw.shuffle(batches[0])
    batches[1] = batches[1] + odd
    got = fed(spark, tmp_path, REQUESTS, batches, keyed.quota)
    assert got == want and {ok for *_, ok in got} == {True, False}


def test_alarms_equal_a_sequential_version(spark, tmp_path):
    draw, start = random.Random(6), dt.date(2024, 3, 1)
    rows = [(draw.randrange(2), n, start + dt.timedelta(days=n // 8), draw.choice([None, 0, 3, 15, 30, 60, 90]), draw.choice([True, True, False, None]), draw.choice([True, False, None])) for n in range(160)]
    want = []
    for store, n, day, items, _, ended in rows:
        seen = [r for r in rows if r[0] == store and r[2] < day and r[4] and (r[3] or 0) > 0]
        last = sorted(r[3] for r in sorted(seen, key=lambda r: (r[2], r[1]))[-7:])
        base = last[len(last) // 2] if last else None
        floor = 10 if base is None else int(min(base, 40) * (0.25 if ended else 0.5))
        want.append((n, items, base, floor, items is None or items < floor))
    # Cut between and within days.
    batches = cut(rows, 3)
    draw.shuffle(batches[2])
    got = fed(spark, tmp_path, LOGS, batches, lambda s: keyed.alarms(s, ["store_id"], 40))
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("query", ["quota", "alarms"])
def test_an_empty_stream(spark, tmp_path, query):
    schema, run = {"quota": (REQUESTS, keyed.quota), "alarms": (LOGS, lambda s: keyed.alarms(s, ["store_id"], 40))}[query]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    out = run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    keyed.written(out, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == 0
