"""Streams give what the batch forms give over the same events."""

import sys
import types

from pyspark.sql import functions as F

from veinway.sources.paged import PagedSource
from veinway.streaming import events as stream

SF = "/root/testdata/sf0.001"


def split_files(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def test_tumbling_and_dedup(spark, tmp_path):
    rows, folder = split_files(spark, tmp_path)
    doubled = stream.read_events(spark, folder, 10)
    out = []
    stream.run_available(stream.tumbling_counts(doubled), str(tmp_path / "c1"), lambda b, n: out.extend(b.collect()), "update")
    last = {(r.start, r.event_type): r.events for r in out}
    want = rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").count().collect()
    assert last == {(r.start, r.event_type): r["count"] for r in want}
    once = []
    stream.run_available(stream.idempotent(stream.read_events(spark, folder, 10)), str(tmp_path / "c2"), lambda b, n: once.extend(b.select("event_id").collect()))
    assert len(once) == len(set(once)) == rows.count()


def test_latest_state(spark, tmp_path):
    rows, folder = split_files(spark, tmp_path)
    out = {}
    stream.run_available(
        stream.latest_state(stream.read_events(spark, folder, 10)), str(tmp_path / "c"), lambda b, n: out.update({r.user_id: (r.event_count, r.event_type) for r in b.collect()}), "update"
    )
    want = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "event_type")).alias("m")).collect()
    assert out == {r.user_id: (r.n, r.m.event_type) for r in want}


def test_fan_out_goes_on_when_a_mirror_fails(spark):
    seen, failed = [], []

    def broken(batch, number):
        raise RuntimeError("down")

    stream.fan_out(lambda b, n: seen.append(("first", n)), broken, lambda b, n: seen.append(("mirror", n)), failed=lambda i, n, e: failed.append((i, n)))(None, 7)
    assert seen == [("first", 7), ("mirror", 7)] and failed == [(0, 7)]


def test_claim(spark):
    jobs = spark.createDataFrame([(1, "pending", 3, 0), (2, "done", 1, 1), (3, "pending", 2, 0)], "job_id int, status string, created_at int, attempts int")
    assert [(r.job_id, r.status, r.worker, r.attempts) for r in stream.claim(jobs, "w", 1).collect()] == [(3, "processing", "w", 1)]


def test_paged_source(spark, tmp_path, monkeypatch):
    (tmp_path / "veinway_pages.py").write_text(
        "class Client:\n    def pages(self): return 2\n    def page(self, i, since): return [(f'{i}-{k}', 't', 'b', 10 * i + k) for k in range(2) if 10 * i + k > since]\nclient = Client()\n"
    )
    sys.path.insert(0, str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", str(tmp_path))
    import veinway_pages

    assert isinstance(veinway_pages, types.ModuleType)
    spark.sparkContext.addPyFile(str(tmp_path / "veinway_pages.py"))
    spark.dataSource.register(PagedSource)
    got = spark.read.format("paged").option("client", "veinway_pages:client").option("since", "0").load()
    assert sorted(r.id for r in got.collect()) == ["0-1", "1-0", "1-1"]
