"""Batch forms of the streaming operators over the events, and extensions that the driver's tables invite (ext_)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .registry import query

c = F.col
STAMP = "'%Y-%m-%d %H:%M:%S'"


def events(t):
    return t.events.withColumn("ts", c("ts").cast("timestamp"))


def shown(df):
    return df.withColumns({x: F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in ("start", "end")}).withColumn("total", F.round("total", 4))


@query("st6_tumbling", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {STAMP}) AS \"start\", strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, {STAMP}) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(t):
    return shown(streams.tumbling(events(t), "ts", "1 hour", "event_type"))


@query("st7_sliding", f"SELECT strftime(s, {STAMP}) AS \"start\", strftime(s + INTERVAL 2 HOUR, {STAMP}) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS s FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL")
def sliding(t):
    return shown(streams.sliding(events(t), "ts", "2 hours", "1 hour", "event_type"))


@query("st8_sessions", f"WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), {STAMP}) AS \"start\", strftime(max(ts) + INTERVAL 30 MINUTE, {STAMP}) AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def sessions(t):
    return shown(streams.sessions(events(t), "ts", "30 minutes", "user_id"))


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing(t):
    d = t.lineitem.where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
