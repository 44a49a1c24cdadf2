"""Queues, outboxes and budgets as set-based state transitions; the caller appends the result and moves one pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded


def identity(prefix: str, length: int, *parts: Column) -> Column:
    """A prefix and the leading hex digits of a SHA-256 over parts joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0000", *(p.cast("string") for p in parts)), 256), 1, length))


def registered(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that aren't there yet, each once; a null part of a key equals a null."""
    known = existing.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.join(known, same, "left_anti").distinct()


def claimable(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The first n jobs that are pending, or running with an expired lease, with one attempt more; first in, first out."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") <= now))
    return jobs.where(free).orderBy("job_id").limit(n).withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("running"))


def finished(jobs: DataFrame, most_attempts: int) -> DataFrame:
    """jobs (ok, attempts): done, pending again, or failed after the last attempt."""
    return jobs.withColumn("status", F.when(F.col("ok"), "done").when(F.col("attempts") >= most_attempts, "failed").otherwise("pending"))


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs with an expired lease are pending again."""
    return jobs.withColumn("status", F.when((F.col("status") == "running") & (F.col("lease_until") <= now), "pending").otherwise(F.col("status")))


def once(entries: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The first entry of each identity: at-least-once delivery made effectively once."""
    return entries.groupBy(*keys).agg(F.min(sequence).alias(sequence))


def within_cap(requests: DataFrame, keys: list[str], order: str, amount: str, cap: float) -> DataFrame:
    """Requests with `granted`: whether the sum of what was granted before and the request's own amount stays within the cap. A refused request leaves
    no trace, so a smaller one after it may fit; a null amount is none."""
    kinds = dict(requests.dtypes)

    def step(used: list, row: tuple) -> tuple:
        fits = used[0] + (row[1] or 0.0) <= cap
        used[0] += (row[1] or 0.0) if fits else 0.0
        return (*row, fits)

    rest = [c for c in requests.columns if c not in (*keys, order, amount)]
    out = [*keys, order, amount, *rest]
    return folded(requests.select(*out), keys, [order], ", ".join([*(f"`{c}` {kinds[c]}" for c in out), "granted boolean"]), lambda: [0.0], step)
