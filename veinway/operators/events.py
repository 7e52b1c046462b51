"""Batch forms of the event operators; veinway.streaming has the continuous ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(events: DataFrame, entity: str, when: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Events within both bounds, inclusive; the caller orders them by time where needed."""
    if since is not None:
        events = events.filter(F.col(when) >= since)
    return events if until is None else events.filter(F.col(when) <= until)


def latest_state(events: DataFrame, keys: list[str], when: str, tie: str, values: list[str]) -> DataFrame:
    """One row per key with the values of its last event and the number of events; a partial aggregate, no sort of groups."""
    last = F.max(F.struct(when, tie, *values)).alias("last")
    return events.groupBy(*keys).agg(F.count("*").alias("event_count"), last).select(*keys, "event_count", f"last.{when}", *[f"last.{v}" for v in values])


def tumbling(events: DataFrame, when: str, width: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(when, width).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def sliding(events: DataFrame, when: str, width: str, step: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(when, width, step).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def sessions(events: DataFrame, when: str, gap: str, by: list[str]) -> DataFrame:
    found = events.groupBy(F.session_window(when, gap).alias("w"), *by).agg(F.count("*").alias("events"), F.max(when).alias("last"))
    return found.select(F.col("w.start").alias("start"), "last", *by, "events")


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key that is not later: one shuffle by key, no range join.

    Both sides are laid on one time line per key and the last right row is carried forward.
    """
    from pyspark.sql.window import Window

    marked = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(_struct(right, right_time, values)))
    other = right.select(F.col(by), F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("at"), *values).alias("_v")).withColumn("_side", F.lit(0))
    line = marked.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*left.columns, F.col("_v.at").alias("matched_at"), *[F.col(f"_v.{v}").alias(v) for v in values])


def _struct(right: DataFrame, right_time: str, values: list[str]) -> str:
    return right.select(F.struct(F.col(right_time).alias("at"), *values).alias("v")).schema["v"].dataType.simpleString()
