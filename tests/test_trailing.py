"""Trailing windows and arrival state: streams against batch forms, with late events, restarts and keys that go."""

import random
import time
from datetime import datetime, timedelta

import pytest

from veinway.streaming import events as stream
from veinway.streaming import trailing

SHAPE = "user_id long, ts timestamp, event_type string, place long"
START = datetime(2024, 1, 1)


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    trailing.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def batch(rng, low, high, n, place=0):
    return [(rng.randrange(6), START + timedelta(days=rng.uniform(low, high)), rng.choice("abc"), place + i) for i in range(n)]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def test_trailing_counts_with_late_events_and_a_restart(spark, tmp_path, rocksdb):
    rng = random.Random(1)
    batches = [batch(rng, 0, 50, 60), batch(rng, 30, 110, 80), batch(rng, 60, 112, 40), [(9, START + timedelta(days=100), "a", 0)]]
    seen, out = [], {}
    for rows in batches:  # each call restarts the stream from its checkpoint
        feed(spark, str(tmp_path / "in"), rows)
        seen += rows
        source = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        stream.run_available(trailing.trailing_counts(source), str(tmp_path / "c"), lambda b, n: out.update({r.user_id: tuple(r) for r in b.collect()}), "update")
        want = {r.user_id: (r.user_id, r.day, r.last_7, r.last_30, r.last_90) for r in trailing.trailing_batch(spark.createDataFrame(seen, SHAPE)).collect()}
        assert out == want


def test_keys_without_events_go(spark, tmp_path, rocksdb):
    out = []
    for rows in ([(1, START, "a", 0), (2, START, "a", 1)], [(2, START + timedelta(days=400), "a", 2)], [(2, START + timedelta(days=401), "a", 3)]):
        feed(spark, str(tmp_path / "in"), rows)
        source = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        stream.run_available(trailing.trailing_counts(source, delay="1 day"), str(tmp_path / "c"), lambda b, n: out.extend(map(tuple, b.collect())), "update")
    first = (START - datetime(1970, 1, 1)).days
    assert (1, first, 1, 1, 1) in out and (1, first + 90, 0, 0, 0) in out
    assert [r for r in out if r[0] == 2][-1] == (2, first + 401, 2, 2, 2)


def test_trailing_batch_of_nothing(spark):
    assert trailing.trailing_batch(spark.createDataFrame([(None, START, "a", 1), (1, None, "a", 2)], SHAPE)).count() == 0


def test_arrival_state(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    out, seen = {}, []
    for i in range(3):
        rows = batch(rng, 0, 90, 30, 100 * i)
        feed(spark, str(tmp_path / "in"), rows)
        seen += rows
        source = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        stream.run_available(trailing.arrival_state(source), str(tmp_path / "c"), lambda b, n: out.update({r.user_id: (r.events, r.ts, r.event_type) for r in b.collect()}), "update")
        last = {u: (sum(x[0] == u for x in seen), t, k) for u, t, k, _ in seen}
        assert out == last


def test_arrival_state_is_forgotten(spark, tmp_path, rocksdb):
    """A time to live needs processing time, in which a stream goes on until it is stopped."""
    out = []
    for i in range(2):
        feed(spark, str(tmp_path / "in"), [(1, START, "a", i)])
        source = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        stream_of = trailing.arrival_state(source, ttl_ms=1).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        running = stream_of.trigger(processingTime="1 second").foreachBatch(lambda b, n: out.extend(r.events for r in b.collect())).start()
        for _ in range(60):
            time.sleep(0.5)
            if len(out) > i:
                break
        running.stop()
    assert out == [1, 1]
