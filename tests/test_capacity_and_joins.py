"""Capacity's cascade of findings, depths by list, and joins that people ask for, on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import lifecycle as L
from shelfmark.operators import review as V

MB = 1_000_000


def found(spark, daily, slow, catalog, days, growth, **own):
    sizes = spark.createDataFrame([("daily", daily * MB), ("slow", slow * MB), ("anything", catalog * MB)], "`group` string, bytes long")
    return L.capacity_by_group(sizes, F.lit(days), F.lit(growth).cast("double"), **({"limit_mb": 500, "keep": 30, "log_keep": 180} | own)).first()


@pytest.mark.parametrize(("figures", "own", "state", "left"), [
    ((20, 10, 100, 10, None), {}, "growth unknown", 999),
    ((20, 10, 100, 10, 0.5), {}, "never pruned", 105),
    ((20, 10, 100, 10, 0.1), {"prune_days": 60}, "not pruned lately", 999),
    ((200, 10, 100, 10, 2.0), {"prune_days": 60}, "over the limit in a year", 8),
    ((20, 0, 100, 10, 2.0), {"prune_days": 60}, "ok", 999),
    ((20, 0, 440, 10, 5.0), {"prune_days": 1, "keep": 1}, "not pruned lately", 999),
    ((0, 0, 460, 10, 0.0), {}, "nearly full", 999),
    ((20, 10, 100, 0, 2.0), {"prune_days": 60}, "over the limit in a year", 11),
])
def test_capacity_finds_the_first_thing_that_is_wrong(spark, figures, own, state, left):
    daily, slow, catalog, days, growth = figures
    row = found(spark, daily, slow, catalog, days, growth, **own)
    assert (row.state, row.total) == (state, daily + slow + catalog)
    # The same rule, step by step.
    limit, keep, log_keep, prune, days = 500, max(14, own.get("keep", 30)), 180, own.get("prune_days"), max(1, days)
    grown = growth or 0.0
    steady = catalog + grown * (365 if prune is None else max(0, prune - days)) + daily / days * keep + slow / days * log_keep
    rate = daily / days + slow / days + grown
    assert row.steady == pytest.approx(steady)
    assert row.days_left == (999 if steady <= limit else int(max(0, limit - daily - slow - catalog) / rate))


def test_growth_leaves_the_first_day_out(spark):
    day = lambda n: dt.date(2024, 3, n)
    seen = spark.createDataFrame([(day(1),)] * 50 + [(day(2),)] * 4 + [(day(3),)] * 2 + [(day(4),)] * 9, "first_seen date")
    sizes = spark.createDataFrame([("catalog", 65 * MB, 65), ("catalog", 65 * MB, 0), ("daily", 7, 0)], "`group` string, bytes long, items long")
    told = lambda days, today=4: spark.range(1).select(L.growth_a_day(seen, F.lit(day(today)), F.lit(days), sizes)).first()[0]
    assert told(4) == pytest.approx((50 + 4 + 2) / 3 * 2)
    assert told(3) == pytest.approx((4 + 2) / 2 * 2)
    assert told(1) is None and told(2, 30) is None


def test_depths_by_list(spark):
    rows = spark.createDataFrame([(s, k, u, r) for s in (1, 2) for k in ("online", "weekly") for u in ("a", "b") for r in range(1, 8)], "store_id int, kind string, unified string, rank int")
    depths = spark.createDataFrame([(1, "online", "a", 3), (1, "online", "a", 5), (2, "weekly", "b", 0), (9, "online", "a", 1)], "store_id int, kind string, unified string, depth int")
    want = {(1, "online", "a"): 5, (2, "weekly", "b"): 0}
    got = sorted(map(tuple, L.trim_by_list(rows, depths, {"weekly": 6}, 4).collect()))
    assert got == sorted(tuple(r) for r in rows.collect() if r[3] > want.get(tuple(r)[:3], 6 if r[1] == "weekly" else 4))


def test_forced_joins(spark):
    items = spark.createDataFrame([(n,) for n in range(1, 11)], "store_book_id long")
    matches = spark.createDataFrame([(1, 2, 90, "manual_split", "auto_high"), (1, 5, 70, "auto_low", None), (8, 9, 60, "rejected", "rejected")], "a long, b long, score int, decision string, auto_decision string")
    asked = {1: [2, 1, 1, 3], 2: [4, 4], 3: list(range(1, 8)), 4: [1, 11], 5: [5, 1], 6: [None, -3, 7], 7: [2, 3, None]}
    chosen = spark.createDataFrame([(r, n) for r, ids in asked.items() for n in ids] + [(None, 1), (None, 2)], "request long, id long")
    verdicts = {r.request: (r.n, r.verdict) for r in V.join_requests(chosen, items).collect()}
    assert verdicts == {1: (3, "ok"), 2: (1, "few"), 3: (7, "many"), 4: (2, "gone"), 5: (2, "ok"), 6: (1, "few"), 7: (2, "ok")}
    got = sorted(map(tuple, V.forced_joins(matches, chosen, items).select("a", "b", "score", "decision", "auto_decision").collect()))
    assert got == [(1, 2, 90, "manual_merge", "auto_high"), (1, 3, 0, "manual_merge", "rejected"), (1, 5, 70, "manual_merge", None), (2, 3, 0, "manual_merge", "rejected"), (8, 9, 60, "rejected", "rejected")]
