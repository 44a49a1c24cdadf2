"""Streaming operators; the batch forms of the windows are the same expressions on a static frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of an append-only ledger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once within the watermark; event time must be a TIMESTAMP."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def batch_sink(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each batch has its own directory, which a replay of the batch overwrites. Nothing that was written is read again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def once(events: DataFrame, keys: list[str], at: str, delay: str, target: str, checkpoint: str) -> StreamingQuery:
    """A started query that writes each key of a stream once: what was seen is kept in the stream's state for as long as a repeat may come
    (`delay` behind the newest event time), and a batch that is run again after a crash replaces what it wrote. Events with a null time are never late."""
    fresh = events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return fresh.writeStream.foreachBatch(batch_sink(target)).option("checkpointLocation", checkpoint).outputMode("append").start()


def tumbling(events: DataFrame, at: str, size: str, *keys: str) -> DataFrame:
    return _windowed(events, F.window(at, size), *keys)


def sliding(events: DataFrame, at: str, size: str, step: str, *keys: str) -> DataFrame:
    return _windowed(events, F.window(at, size, step), *keys)


def sessions(events: DataFrame, at: str, gap: str, *keys: str) -> DataFrame:
    return _windowed(events, F.session_window(at, gap), *keys)


def _windowed(events: DataFrame, window, *keys: str) -> DataFrame:
    counted = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


class LeaseKeeper(StatefulProcessor):
    """Leases keyed by job: a claim starts one, done or failed ends it, and a timer gives it back when it expires.

    Rows are (job_id, action, at_ms, lease_ms); results (job_id, status, attempts). A timer of an earlier lease leaves a later one alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "status string, attempts int, until long, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, until, expires = self.state.get() if self.state.exists() else ("pending", 0, 0, 0)
        for r in (r for frame in rows for r in frame.sort_values("at_ms").itertuples()):
            if r.action == "claim" and (status == "pending" or (status == "running" and until <= r.at_ms)):
                status, attempts, until = "running", attempts + 1, int(r.at_ms + r.lease_ms)
                expires = timerValues.getCurrentProcessingTimeInMs() + int(r.lease_ms)
                self.handle.registerTimer(expires)
            elif r.action in ("done", "failed") and status == "running":
                status = r.action
        self.state.update((status, attempts, until, expires))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, until, expires = self.state.get()
        if status == "running" and expires <= timerValues.getCurrentProcessingTimeInMs():
            self.state.update(("pending", attempts, until, expires))
            yield pd.DataFrame({"job_id": [key[0]], "status": ["pending"], "attempts": [attempts]})

    def close(self) -> None:
        pass


def leases(events: DataFrame) -> DataFrame:
    """(job_id, status, attempts) of a stream of (job_id, action, at_ms, lease_ms): a row for each change, also when a lease expires without an event. The stream needs
    the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(LeaseKeeper(), "job_id long, status string, attempts int", "append", "processingTime")


def budget_granted(events: DataFrame, cap: float) -> DataFrame:
    """(request_id, granted) for a stream of (account, request_id, amount): requests of an account, in order, while its total stays within the cap."""

    def grant(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        for frame in frames:
            out = []
            for r in frame.sort_values("request_id").itertuples():
                fits = used + r.amount <= cap
                used += r.amount if fits else 0.0
                out.append((r.request_id, fits))
            yield pd.DataFrame(out, columns=["request_id", "granted"])
        state.update((used,))

    return events.groupBy("account").applyInPandasWithState(grant, "request_id long, granted boolean", "used double", "append", "NoTimeout")
