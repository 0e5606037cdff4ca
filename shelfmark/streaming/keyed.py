"""Streams that remember something of each key: a quota of live grants, and alarms on low counts.

State is bounded for each key (as many expiries as the quota allows, twice SEEN counts) and kept in the state store, so a query that stops
is taken up again from its checkpoint. Rows of one batch are judged in the order of their time and number, batches as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfmark.operators.ingest import CUT_OFF, FIRST_DAY, REACHED

#: Counts that a baseline is the median of.
SEEN = 7
HOUR = 3_600_000_000

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Quota(StatefulProcessor):
    def __init__(self, most: int, hours: int):
        self.most, self.hours = most, hours

    def init(self, handle) -> None:
        self.live = handle.getValueState("live", "until array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        live = list(self.live.get()[0]) if self.live.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        granted = []
        for ts, hours in zip(batch["ts"], batch["hours"], strict=True):
            live = [t for t in live if t > ts]
            ok = len(live) < self.most
            if ok:
                live.append(int(ts) + HOUR * (self.hours if pd.isna(hours) else int(min(max(hours, 1), self.hours))))
            granted.append(ok)
        self.live.update((live,))
        yield pd.DataFrame({"request_id": batch["request_id"], "user_id": key[0], "granted": granted})

    def close(self) -> None:
        pass


class _Alarm(StatefulProcessor):
    def __init__(self, want: int):
        self.want = want

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "day date, before array<int>, own array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        day, before, own = self.seen.get() if self.seen.exists() else (None, [], [])
        before, own = list(before), list(own)
        batch = pd.concat(list(rows)).sort_values(["snapshot_date", "log_id"], kind="stable")
        out = []
        for at, number, items, good, ended in zip(*(batch[c] for c in ("snapshot_date", "log_id", "items", "good", "ended")), strict=True):
            if day is None or at > day:
                day, before, own = at, (before + own)[-SEEN:], []
            base = sorted(before)[len(before) // 2] if before else None
            floor = FIRST_DAY if base is None else int(min(base, self.want) * (REACHED if ended else CUT_OFF))
            out.append((number, items, base, floor, bool(pd.isna(items) or items < floor)))
            if good and items > 0:
                own = (own + [int(items)])[-SEEN:]
        self.seen.update((day, before, own))
        yield pd.DataFrame(out, columns=["log_id", "items", "baseline", "floor", "low"]).astype({"items": "Int32", "baseline": "Int32"})

    def close(self) -> None:
        pass


def quota(requests: DataFrame, most: int = 2, hours: int = 3) -> DataFrame:
    """request_id, user_id, granted of a stream (request_id, user_id, ts, hours).

    A user has at most `most` grants that live at a time. One lives as many hours as were asked for, from 1 to `hours`, null counting as `hours`;
    at its very end it is over. A refused request does not count. Rows without a user, time or number are left out.
    """
    rows = requests.select("request_id", "user_id", F.unix_micros("ts").alias("ts"), "hours").dropna(subset=["request_id", "user_id", "ts"])
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy("user_id").transformWithStateInPandas(_Quota(most, hours), "request_id long, user_id long, granted boolean", "append", "none")


def alarms(logs: DataFrame, keys: list[str], want: int) -> DataFrame:
    """log_id, items, baseline, floor, low of a stream (keys, log_id, snapshot_date, items, good, ended).

    baseline: the upper median of the key's last SEEN counts above 0 of good runs of earlier days, null while there are none. A row is low if it has
    fewer items than the floor (or none at all): a share of the smaller of baseline and want, by whether the list's end was seen (ended; null: not). A row of an
    earlier day than the latest that its key had is judged and counted as one of the latest day. Rows without a key, number or day are left out.
    """
    rows = logs.select(*keys, "log_id", "snapshot_date", "items", "good", "ended").dropna(subset=[*keys, "log_id", "snapshot_date"]).fillna(False, ["good", "ended"])
    logs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(_Alarm(want), "log_id long, items int, baseline int, floor int, low boolean", "append", "none")


def written(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there and add the result's rows to a folder, each once, also if a batch runs again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
