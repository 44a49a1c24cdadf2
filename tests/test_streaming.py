import os
import time

import pandas as pd
from pyspark.sql import functions as F

from stratafolio.streaming import streams


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_each_key_is_written_once_across_restarts_and_replays(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "id long, v string, at timestamp").schema

    def add(*rows):
        spark.createDataFrame(rows, "id long, v string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)

    def run():
        drain(streams.once(streams.tail(spark, source, schema), ["id"], "at", "1 hour", target, str(tmp_path / "cp")))
        return sorted(r.id for r in spark.read.parquet(target).collect())

    add((1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:05:00"), (2, "b", "2024-01-01 00:10:00"))
    assert run() == [1, 2]
    add((2, "b", "2024-01-01 00:20:00"), (3, "c", "2024-01-01 00:30:00"))
    assert run() == [1, 2, 3]  # what was seen survives the restart
    batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    again = spark.createDataFrame(spark.read.parquet(f"{target}/batch={batch}").collect(), schema)
    streams.batch_sink(target)(again, batch)  # a replay of the last batch
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_keyed_deduplication_within_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00"), (1, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "id long, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = streams.deduplicated(streams.tail(spark, source, spark.read.parquet(source).schema), "id", "at", "10 minutes")
    drain(stream.writeStream.format("memory").queryName("deduplicated").outputMode("append").start())
    assert sorted(r.id for r in spark.sql("SELECT * FROM deduplicated").collect()) == [1, 2]


def test_windows_stream_as_in_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", "u", float(k)) for k in range(50)] + [(99, "2024-01-01 05:00:00", "u", 0.0)]
    spark.createDataFrame(rows, "id long, ts string, user string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    static = spark.read.parquet(source)
    stream = streams.tail(spark, source, static.schema).withWatermark("ts", "1 minute")
    query = streams.tumbling(stream, "ts", "10 minutes", "user").writeStream.format("memory").queryName("tumbled").outputMode("append").start()
    drain(query)
    want = {(r.start, r.n) for r in streams.tumbling(static.where("id < 99"), "ts", "10 minutes", "user").collect()}
    assert {(r.start, r.n) for r in spark.sql("SELECT * FROM tumbled").collect()} == want


def test_budget_state(spark, tmp_path):
    source = str(tmp_path / "requests")
    spark.createDataFrame([("a", 1, 6.0), ("a", 2, 6.0), ("a", 3, 4.0), ("b", 4, 1.0)], "account string, request_id long, amount double").coalesce(1).write.parquet(source)
    stream = streams.tail(spark, source, spark.read.parquet(source).schema)
    drain(streams.budget_granted(stream, 10.0).writeStream.format("memory").queryName("granted").outputMode("append").start())
    assert {r.request_id: r.granted for r in spark.sql("SELECT * FROM granted").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_lease_keeper():
    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers = []

        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        now = 1000

        def getCurrentProcessingTimeInMs(self):
            return self.now

    keeper, rows, clock = streams.LeaseKeeper(), lambda *r: iter([pd.DataFrame(r, columns=["job_id", "action", "at_ms", "lease_ms"])]), Clock()
    keeper.init(Handle())
    last = lambda it: list(it)[-1].iloc[0].to_dict()
    assert last(keeper.handleInputRows((1,), rows((1, "claim", 0, 50), (1, "claim", 10, 50)), clock)) == {"job_id": 1, "status": "running", "attempts": 1}
    assert list(keeper.handleExpiredTimer((1,), clock, None)) == []  # a timer of an earlier lease
    clock.now = 1050
    assert last(keeper.handleExpiredTimer((1,), clock, None)) == {"job_id": 1, "status": "pending", "attempts": 1}
    assert last(keeper.handleInputRows((1,), rows((1, "claim", 99, 50), (1, "done", 100, 0)), clock))["status"] == "done"
    assert list(keeper.handleExpiredTimer((1,), clock, None)) == []


def test_leases_expire_in_a_running_stream_and_survive_a_restart(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "job_id long, action string, at_ms long, lease_ms long"
    schema = spark.createDataFrame([], kind).schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def seen():
        return {(r.job_id, r.status, r.attempts) for r in spark.read.schema("job_id long, status string, attempts int").parquet(target).collect()}

    def run(until, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = streams.leases(streams.tail(spark, source, schema)).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        end = time.time() + 90
        while time.time() < end and not (os.path.isdir(target) and until <= seen()):
            assert query.exception() is None
            time.sleep(0.5)
        query.stop()
        return seen()

    try:
        first = run({(1, "running", 1), (1, "pending", 1), (2, "running", 1)}, (1, "claim", 0, 300), (2, "claim", 0, 3_600_000))
        assert first == {(1, "running", 1), (1, "pending", 1), (2, "running", 1)}
        second = run(first | {(1, "running", 2), (2, "done", 1)}, (1, "claim", 5000, 3_600_000), (2, "done", 6000, 0))
        assert second == first | {(1, "running", 2), (2, "done", 1)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
