"""Structured Streaming forms of the event operators. Each gives the same rows as its batch form over the same events."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1, schema: str = EVENTS) -> DataFrame:
    """An append-only event log of Parquet files, with its event time as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(events: DataFrame, id_column: str = "event_id", when: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each id once, as long as its repetition comes within the watermark."""
    return events.withWatermark(when, delay).dropDuplicatesWithinWatermark([id_column])


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), "event_type", "events")


def session_counts(events: DataFrame, gap: str = "6 hours", delay: str = "12 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return w.select(F.col("w.start").alias("start"), "last", "user_id", "events")


def latest_state(events: DataFrame, arrival: bool = False) -> DataFrame:
    """(user_id, event_count, ts, event_type) after each batch: the last event by event time, or by arrival.

    State is one small row per user and lives in the state store; the batch's events of a user are
    folded as they come, none is kept.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, ts, kind = state.get if state.exists else (0, None, None)
        for frame in frames:
            count += len(frame)
            row = frame.iloc[-1] if arrival else frame.sort_values(["ts", "event_id"], kind="stable").iloc[-1]
            if arrival or ts is None or row["ts"] >= ts:
                ts, kind = row["ts"].to_pydatetime(), row["event_type"]
        state.update((count, ts, kind))
        yield pd.DataFrame({"user_id": [key[0]], "event_count": [count], "ts": [ts], "event_type": [kind]})

    shape = "event_count long, ts timestamp, event_type string"
    return events.groupBy("user_id").applyInPandasWithState(fold, f"user_id long, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what there is in micro-batches and stops; the checkpoint is the cursor for the next call."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def fan_out(first: Callable[[DataFrame, int], None], *mirrors: Callable[[DataFrame, int], None], failed: Callable[[int, int, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that writes the first target and then its mirrors; a mirror that fails is reported and does not stop the stream."""

    def write(batch: DataFrame, number: int) -> None:
        first(batch, number)
        for i, mirror in enumerate(mirrors):
            try:
                mirror(batch, number)
            except Exception as e:
                if failed:
                    failed(i, number, e)

    return write


def claim(jobs: DataFrame, worker: str, n: int) -> DataFrame:
    """The n oldest pending jobs marked as taken by a worker; within a micro-batch there is one caller, so no lock is needed."""
    oldest = jobs.filter("status = 'pending'").orderBy("created_at", "job_id").limit(n)
    return oldest.withColumn("status", F.lit("processing")).withColumn("worker", F.lit(worker)).withColumn("attempts", F.col("attempts") + 1)
