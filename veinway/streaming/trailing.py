"""Keyed state over event streams that ages: trailing windows and the last arrival.

The processors keep a few small entries for each key in the state store (RocksDB), so a key with very many
events costs as much as any other; a batch's events of a key are added up before they touch the
state. The state store's provider is set by `use_rocksdb`.
"""

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

DAY_MS = 86_400_000
WINDOWS = (7, 30, 90)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Trailing(StatefulProcessor):
    """Counts by day for one key: {day: events} for the longest window, and the last day."""

    def __init__(self, windows: tuple[int, ...]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "events long")
        self.last = handle.getValueState("last", "day int")

    def _row(self, key: tuple, last: int, counts: dict[int, int]) -> pd.DataFrame:
        row: dict[str, list[Any]] = {"user_id": [key[0]], "day": [last]}
        for w in self.windows:
            row[f"last_{w}"] = [sum(n for d, n in counts.items() if d > last - w)]
        return pd.DataFrame(row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for frame in rows:
            for day, n in frame.groupby("day")["events"].sum().items():
                new[int(day)] = new.get(int(day), 0) + int(n)
        counts = {int(k[0]): int(v[0]) for k, v in self.days.iterator()}
        before = int(self.last.get()[0]) if self.last.exists() else None
        last = max(new) if before is None else max(before, *new)
        for day, n in new.items():
            if day > last - max(self.windows):
                counts[day] = counts.get(day, 0) + n
                self.days.updateValue((day,), (counts[day],))
        for day in [d for d in counts if d <= last - max(self.windows)]:
            self.days.removeKey((day,))
            del counts[day]
        if last != before:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + max(self.windows)) * DAY_MS)
        yield self._row(key, last, counts)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Nothing came for the longest window: the key's state goes, and its counts are 0 as of that day."""
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        self.days.clear()
        self.last.clear()
        yield self._row(key, day, {})

    def close(self) -> None:
        pass


def day_number(ts: str) -> Column:
    return F.unix_date(F.to_date(ts))


def trailing_counts(events: DataFrame, windows: tuple[int, ...] = WINDOWS, delay: str = "90 days") -> DataFrame:
    """(user_id, day, last_7, last_30, last_90) of a stream of (user_id, ts): after each batch a row for every user that it changed.

    `day` is the number of the user's last day with events, counted from 1970, and the counts are of the windows that end with it.
    Events that come late, within the watermark's delay, count for their own day. When the watermark has passed
    the longest window after a user's last day, a row of zeros is given and nothing is kept of him.
    """
    days = events.withWatermark("ts", delay).select("user_id", "ts", day_number("ts").cast("int").alias("day"), F.lit(1).cast("long").alias("events"))
    shape = "user_id long, day int, " + ", ".join(f"last_{w} long" for w in windows)
    return days.filter("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id").transformWithStateInPandas(Trailing(windows), shape, "Update", "EventTime")


def trailing_batch(events: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """What `trailing_counts` comes to over all events: two aggregations, the first by user and day."""
    days = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id", day_number("ts").alias("day")).agg(F.count("*").alias("events"))
    dated = days.withColumn("end", F.max("day").over(Window.partitionBy("user_id")))  # one row a day
    each = [F.coalesce(F.sum(F.when(F.col("day") > F.col("end") - w, F.col("events"))), F.lit(0)).alias(f"last_{w}") for w in windows]
    return dated.groupBy("user_id", "end").agg(*each).withColumnRenamed("end", "day")


class Arrival(StatefulProcessor):
    """The last event of a key as it came in, and how many came; gone when nothing came for a while."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entity", "events long, ts timestamp, event_type string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = int(self.state.get()[0]) if self.state.exists() else 0
        last = None
        for frame in rows:
            events += len(frame)
            best = frame.loc[frame["place"].idxmax()]
            last = best if last is None or best["place"] > last["place"] else last
        ts = None if pd.isna(last["ts"]) else pd.Timestamp(last["ts"]).to_pydatetime()
        self.state.update((events, ts, last["event_type"]))
        yield pd.DataFrame({"user_id": [key[0]], "events": [events], "ts": [last["ts"]], "event_type": [last["event_type"]], "refreshed_at": [datetime.now(timezone.utc).replace(tzinfo=None)]})

    def close(self) -> None:
        pass


def arrival_state(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, events, ts, event_type, refreshed_at) after each batch: what came last counts, whatever its own time.

    `place` in `events` is the order of arrival within a batch (a sequence number of the log); batches follow each
    other. With `ttl_ms` a user's state is forgotten when nothing came for so long; that needs processing time, in which
    a stream runs until it is stopped, also where it is told to take what is there.
    """
    rows = events.filter("user_id IS NOT NULL").select("user_id", "ts", "event_type", "place")
    return rows.groupBy("user_id").transformWithStateInPandas(Arrival(ttl_ms), "user_id long, events long, ts timestamp, event_type string, refreshed_at timestamp", "Update", "None" if ttl_ms is None else "ProcessingTime")
