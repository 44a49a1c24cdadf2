import random

from pyspark.sql import functions as F

from stratafolio.operators import ledger
from stratafolio.operators.ledger import EVENT, Account, Caps
from stratafolio.streaming import streams


def event(account, sequence, action, reservation, est=None, tokens=None, kind="chat", counts=True, page=False):
    return (account, sequence, action, reservation, kind, est, counts, page, tokens)


def run(spark, rows, caps):
    got = ledger.folded(spark.createDataFrame(rows, EVENT).repartition(3), caps).collect()
    return {(r.account, r.sequence): (r.outcome, r.input, r.requests, r.pages) for r in got}


def test_a_refusal_leaves_no_trace(spark):
    """80 of 100, then 50 is refused, and 10 still fits."""
    got = run(spark, [event("a", 1, "reserve", "x", 80), event("a", 2, "reserve", "y", 50), event("a", 3, "reserve", "z", 10), event("b", 1, "reserve", "x", 100)], Caps(input=100))
    assert got == {("a", 1): ("reserved", 80, 1, 0), ("a", 2): (ledger.OVER_INPUT, 80, 1, 0), ("a", 3): ("reserved", 90, 2, 0), ("b", 1): ("reserved", 100, 1, 0)}


def test_settle_fail_release_and_replays(spark):
    rows = [event("a", k, *r) for k, r in enumerate([("reserve", "x", 8), ("settle", "x", None, 6), ("reserve", "y", 4), ("fail", "y"), ("fail", "y"), ("settle", "x", None, 9), ("settle", "y", None, 3), ("reserve", "w", 5), ("release", "w"), ("settle", "nobody"), ("fail", "nobody"), ("reserve", "x", 3), ("reserve", "v", 0), ("settle", "v"), ("release", "v"), ("settle", "v")])]
    got = [v for _, v in sorted(run(spark, rows, Caps(input=50)).items())]
    assert [g[0] for g in got] == ["reserved", "settled", "reserved", "unknown", "replayed", "replayed", "already_charged", "reserved", "released", "unknown_reservation", "ignored", "replayed", "reserved", "settled", "released", "already_charged"]
    assert [g[1] for g in got] == [8, 6, 10, 10, 10, 10, 10, 15, 10, 10, 10, 10, 11, 11, 11, 11]
    assert got[-1][2] == 3


def test_requests_and_pages(spark):
    rows = [event("a", 1, "reserve", "x", 1, page=True), event("a", 2, "reserve", "y", 1, page=True), event("a", 3, "reserve", "z", 1), event("a", 4, "fail", "x"), event("a", 5, "reserve", "u", 1, page=True), event("a", 6, "reserve", "v", 1, kind="http-attempt", counts=False), event("a", 7, "reserve", "w", 1, kind="chat", counts=False)]
    got = [v for _, v in sorted(run(spark, rows, Caps(requests=2, pages=1)).items())]
    assert got == [("reserved", 1, 1, 1), (ledger.OVER_PAGES, 1, 1, 1), ("reserved", 2, 2, 1), ("unknown", 2, 2, 1), (ledger.OVER_REQUESTS, 2, 2, 1), (ledger.OVER_REQUESTS, 2, 2, 1), ("reserved", 3, 2, 1)]


def rows_at_random(seed, n=400):
    rng = random.Random(seed)
    return [event(rng.choice("abc"), k, rng.choice(["reserve", "reserve", "settle", "fail", "release"]), str(rng.randint(0, 60)), rng.randint(0, 30), rng.choice([None, 0, 7]), rng.choice(["chat", "http-attempt", "other"]), rng.random() < 0.7, rng.random() < 0.3) for k in range(n)]


def test_totals_are_sums_over_the_reservations():
    """Against totals counted anew from all reservations and usage after each event."""
    for seed in range(30):
        caps, state, usage = Caps(200, 25, 8), Account(), {}
        for _, _, action, rid, kind, est, counts, page, tokens in rows_at_random(seed):
            outcome = state.apply(caps, action, rid, kind, est, counts, page, tokens)
            if outcome == "settled":
                k, e, c = state.held[rid][:3]
                usage[rid] = (tokens or e, 1 if k in ledger.CALLS else c, k == "vision-page")
            elif outcome == "unknown":
                k, e, c = state.held[rid][:3]
                usage[rid] = (e, 1 if k == "http-attempt" else c, False)
            live = [r for r in state.held.values() if r[3] == "reserved"]
            pages = sum(r[0] == "vision-page" and r[3] in ("reserved", "unknown") for r in state.held.values())
            want = (sum(u[0] for u in usage.values()) + sum(r[1] for r in live), sum(u[1] for u in usage.values()) + sum(r[2] for r in live), sum(u[2] for u in usage.values()) + pages)
            assert state.totals() == want
            assert outcome != "reserved" or (want[0] <= 200 and want[2] <= 8)


def test_a_stream_restarted_from_its_checkpoint_agrees_with_the_batch(spark, tmp_path):
    rows, caps = rows_at_random(5, 120), Caps(120, 12, 4)
    source, target = str(tmp_path / "events"), str(tmp_path / "out")
    schema = spark.createDataFrame([], EVENT).schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in (0, 60):
            spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(source)
            stream = ledger.stream_folded(streams.tail(spark, source, schema), caps)
            query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.account, r.sequence): (r.outcome, r.input, r.requests, r.pages) for r in spark.read.parquet(target).collect()}
    assert got == run(spark, rows, caps)


def test_nulls_and_no_events(spark):
    assert run(spark, [], Caps()) == {}
    got = run(spark, [(None, 1, "reserve", "x", None, None, None, None, None), ("a", 1, "shout", "x", None, None, None, None, None)], Caps(input=1))
    assert got == {(None, 1): ("reserved", 1, 1, 0), ("a", 1): ("ignored", 0, 0, 0)}
    frame = spark.createDataFrame([("a", 1, 2)], "account string, sequence int, other int").select("*", F.lit("reserve").alias("action"), F.lit("r").alias("reservation_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("est_input", "long"), ("counts_request", "boolean"), ("as_page", "boolean"), ("input_tokens", "long"))))
    assert ledger.folded(frame, Caps()).first().outcome == "reserved"
