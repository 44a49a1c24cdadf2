import datetime
import json

import pytest
from pyspark.sql import functions as F

from stratafolio.functions import dates, text
from stratafolio.operators import memory

CLAIM = "claim_id string, statement string, evidence string, counterevidence string"
REVIEW = "claim_id string, sequence long, action string, reviewer string, new_statement string, new_evidence string, new_counterevidence string"


def test_every_review_appends_and_only_some_change_what_is_said(spark):
    claims = spark.createDataFrame([("c", "first", "[1]", "[]"), ("d", "other", "[]", "[]")], CLAIM)
    reviews = spark.createDataFrame([("c", 1, "accept", "r", "ignored", "[9]", None), ("c", 2, "revise", "r", "second", "[2]", None), ("c", 3, "challenge", "r", None, None, None), ("c", 4, "supersede", "r", "", None, "[3]"), ("c", 5, "praise", "r", None, None, None), ("x", 1, "accept", "r", None, None, None)], REVIEW)
    rows = memory.reviewed(claims, reviews).collect()
    got = {(r.claim_id, r.revision): (r.statement, r.status, r.evidence, r.counterevidence, r.supersedes_revision) for r in rows if r.error is None}
    assert got == {
        ("c", 1): ("first", "proposed", "[1]", "[]", None), ("c", 2): ("first", "accepted", "[1]", "[]", None), ("c", 3): ("second", "proposed", "[2]", "[]", 2),
        ("c", 4): ("second", "challenged", "[2]", "[]", None), ("c", 5): ("second", "superseded", "[2]", "[3]", 4), ("d", 1): ("other", "proposed", "[]", "[]", None),
    }
    assert sorted((r.claim_id, r.error) for r in rows if r.error) == [("c", "unknown action"), ("x", "claim not found")]


def test_decisions_freeze_revisions(spark):
    revisions = spark.createDataFrame([("c", 1, "first"), ("c", 2, "second"), ("d", 1, "other")], "claim_id string, revision int, statement string")
    decisions = spark.createDataFrame([("x", [("c", 1), ("c", None), ("d", None), ("e", None), ("d", 7)])], "decision_id string, refs array<struct<claim_id:string,revision:int>>")
    got = sorted((r.claim_id, r.revision, r.statement, r.error) for r in memory.frozen_decisions(decisions, revisions).collect() if r.claim_id != "e")
    assert got == [("c", 1, "first", None), ("c", 2, "second", None), ("d", 1, "other", None), ("d", 7, None, None)]
    assert [r.error for r in memory.frozen_decisions(decisions, revisions).where("claim_id = 'e'").collect()] == ["claim not found"]


def test_new_versions_propose_reviews_once(spark):
    claims = spark.createDataFrame([("c", 2, json.dumps([{"deep": {"source": "s", "doc_id": "d1"}}])), ("e", 1, json.dumps({"source": "s", "doc_id": "d2"})), ("n", 1, None)], "claim_id string, revision int, evidence string")
    versions = spark.createDataFrame([("s", "d1", "v2"), ("s", "d1", "v2"), ("t", "d2", "v1")], "source string, doc_id string, version_id string")
    none = spark.createDataFrame([], "proposal_id string")
    first = memory.proposals(versions, claims, none)
    assert [(r.claim_id, r.version_id, r.affected_revision, r.event_id == f"evt-{r.proposal_id}") for r in first.collect()] == [("c", "v2", 2, True)]
    assert memory.proposals(versions, claims, first).count() == 0
    asked = spark.createDataFrame([("a", "dismiss"), ("b", "accept"), ("c", "accept"), ("d", "shrug"), ("e", "accept")], "proposal_id string, action string")
    there = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "resolved"), ("d", "open")], "proposal_id string, status string")
    got = {r.proposal_id: (r.status, r.error) for r in memory.resolved(there, asked).collect()}
    assert got == {"a": ("dismissed", None), "b": ("resolved", None), "c": ("resolved", "proposal not found or not open"), "d": ("open", "action must be dismiss or accept"), "e": (None, "proposal not found or not open")}


def test_a_second_repair_finds_nothing(spark):
    versions = spark.createDataFrame([("s", "d1", "v1", "2020-02-01", "2020-01-01", "published_at"), ("s", "d2", "v1", "2020-01-01", "2020-02-01", "published_at"), ("s", "d3", "v1", "2020-02-01", "2020-01-01", "adapter"), ("s", "d4", "v1", None, "2020-01-01", "filing_date")], "source string, doc_id string, version_id string, first_observed_at string, public_available_at string, public_time_basis string")
    none = spark.createDataFrame([], "source string, doc_id string, version_id string, old_available_at string")
    fixed, rows = memory.repaired_public_times(versions, none)
    assert {r.doc_id: (r.public_available_at, r.public_time_basis) for r in fixed.collect()} == {"d1": (None, "unknown"), "d2": ("2020-02-01", "published_at"), "d3": ("2020-01-01", "adapter"), "d4": (None, "unknown")}
    assert sorted((r.doc_id, r.old_available_at, r.old_basis, r.new_basis) for r in rows.collect()) == [("d1", "2020-01-01", "published_at", "unknown"), ("d4", "2020-01-01", "filing_date", "unknown")]
    again, more = memory.repaired_public_times(fixed, rows)
    assert more.count() == 0 and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, fixed.collect()), key=repr)


def test_events_are_numbered_on_and_emitted_once(spark):
    log = spark.createDataFrame([("a", 7)], "event_id string, sequence long")
    events = spark.createDataFrame([("a", 1, "x"), ("c", 3, "y"), ("b", 2, "z"), ("c", 9, "later")], "event_id string, at int, payload string")
    got = {r.event_id: (r.sequence, r.payload) for r in memory.emitted(log, events, ["at"]).collect()}
    assert got == {"b": (8, "z"), "c": (9, "y")}
    assert memory.emitted(log.limit(0), events, ["at"]).agg(F.max("sequence")).first()[0] == 3


def test_blocked_entities_are_queued_once_and_results_are_reused(spark):
    summaries = spark.createDataFrame([("t", "a", 1, "blocked", None), ("t", "a", 2, "done", "k1"), ("t", "b", 3, "blocked", None), ("t", "a", 4, "done", "k1")], "entity_type string, entity_id string, revision int, status string, event_key string")
    outbox = spark.createDataFrame([("refresh:t:a:1",)], "event_key string")
    assert [tuple(r) for r in memory.blocked_refreshes(summaries, outbox).collect()] == [("t", "b", 3, "refresh:t:b:3")]
    events = spark.createDataFrame([("k1",), ("k2",), (None,)], "event_key string")
    assert {r.event_key: r.reused_revision for r in memory.reused(events, summaries).collect()} == {"k1": 4, "k2": None, None: None}


DAY = datetime.datetime


def test_background_packages(spark):
    docs = spark.createDataFrame([("E", "s", "d1", "2019"), ("E", "s", "d2", None), ("E", "s", "d3", "2020"), ("F", "s", "d1", "2019")], "entity string, source string, doc_id string, report_period string")
    v = "source string, doc_id string, version_id string, first_observed_at timestamp, public_available_at timestamp, synced_at timestamp, is_current boolean"
    versions = spark.createDataFrame([("s", "d1", "v1", DAY(2020, 1, 1), DAY(2020, 3, 1), None, False), ("s", "d1", "v2", DAY(2020, 6, 1), None, None, True), ("s", "d2", "v1", DAY(2020, 1, 1), DAY(2020, 1, 1), None, True), ("s", "d3", "v1", None, None, None, True)], v)
    extractions = spark.createDataFrame([("s", "d1", "v1", "e1", DAY(2020, 1, 2), 1), ("s", "d1", "v1", "e2", DAY(2020, 5, 1), 2), ("s", "d1", "v2", "e3", DAY(2020, 6, 2), 3)], "source string, doc_id string, version_id string, extraction_id string, created_at timestamp, ingest_seq long")
    blocks = spark.createDataFrame([("e1", k, f"e1-{k}", "fine" if k != 1 else "\x01\x02\x03\x04\x05") for k in range(5)] + [("e3", 0, "e3-0", "fine")], "extraction_id string, ordinal int, block_id string, text string")

    def sources(cutoff, mode, limit=50):
        rows = memory.background_sources(docs, versions, extractions, blocks, cutoff and F.lit(cutoff).cast("timestamp"), mode, limit).collect()
        return {(r.entity, r["rank"]): (r.doc_id, r.version_id, r.extraction_id, [x.block_id for x in r.refs]) for r in rows}

    assert sources("2020-04-01", "system") == {("E", 1): ("d2", "v1", None, []), ("E", 2): ("d1", "v1", "e1", ["e1-0", "e1-2"]), ("F", 1): ("d1", "v1", "e1", ["e1-0", "e1-2"])}
    assert sources("2020-02-01", "public") == {("E", 1): ("d2", "v1", None, [])}
    assert sources(None, "system") == {("E", 1): ("d2", "v1", None, []), ("E", 2): ("d3", "v1", None, []), ("E", 3): ("d1", "v2", "e3", ["e3-0"]), ("F", 1): ("d1", "v2", "e3", ["e3-0"])}
    assert sources(None, "system", 1) == {("E", 1): ("d2", "v1", None, []), ("F", 1): ("d1", "v2", "e3", ["e3-0"])}

    ref = lambda d, v, b: {"source": "s", "doc_id": d, "version_id": v, "block_id": b}
    claims = spark.createDataFrame([(k, "E", DAY(2020, 1, 1)) for k in ("ok", "stale", "old", "hidden", "none", "bad")] + [("late", "E", DAY(2021, 1, 1))], "claim_id string, entity string, created_at timestamp")
    rows = [("ok", 1, [ref("d2", "v1", "b1")], 2020), ("ok", 2, [ref("d2", "v1", "b1")], 2021), ("stale", 1, [ref("d2", "v1", "b1")], 2020), ("old", 1, [ref("d2", "v1", "b2")], 2020), ("hidden", 1, [ref("d1", "v2", "b1")], 2020), ("none", 1, [], 2020), ("bad", 1, [ref("d2", "v1", "b1"), ref("d9", "v1", "b1")], 2020), ("late", 1, [ref("d2", "v1", "b1")], 2021)]
    revisions = spark.createDataFrame([(k, n, f"{k} {n}", "accepted", json.dumps(e), None, DAY(y, 1, 1)) for k, n, e, y in rows], "claim_id string, revision int, statement string, status string, evidence string, counterevidence string, created_at timestamp")
    shown = spark.createDataFrame([("b1", "e", "s", "d", "v", False), ("b2", "e", "s", "d", "v", False)], "block_id string, extraction_id string, source string, doc_id string, version_id string, risky boolean")
    heads = spark.createDataFrame([("b2", "p")], "block_id string, projection_id string")
    stale = spark.createDataFrame([("stale", 1)], "claim_id string, revision int")
    said = lambda *more: {r.claim_id: r.revision for r in memory.background_claims(claims, revisions, versions, shown, heads, stale, *more).collect()}
    assert said() == {"ok": 2, "hidden": 1, "none": 1, "bad": 1, "late": 1}
    assert said(F.lit("2020-07-01").cast("timestamp"), "system") == {"ok": 1, "hidden": 1, "none": 1, "bad": 1}
    assert said(F.lit("2020-07-01").cast("timestamp"), "public") == {"ok": 1}


def test_cutoffs_that_cannot_be_read_are_errors(spark):
    frame = lambda v: spark.createDataFrame([(v,)], "t string").select(dates.cutoff_of(F.col("t")).alias("c"))
    assert frame("2020-01-01T08:00:00+08:00").first().c == DAY(2020, 1, 1) and frame("2020-01-01").first().c == DAY(2020, 1, 1) and frame(None).first().c is None
    with pytest.raises(Exception, match="malformed cutoff"):
        frame("soon").collect()


def test_long_citations_and_names(spark):
    frame = spark.createDataFrame([("see [3] [12345678901] [007] [" + "9" * 60 + "] [a]",), (None,)], "t string")
    got = [r.c for r in frame.select(text.citations(F.col("t")).alias("c")).collect()]
    assert [int(x) for x in got[0]] == [3, 7, 12345678901, 10**38 - 1] and got[1] is None
    names = spark.createDataFrame([("ok-1.2",), ("a/b",), ("..",), ("é ü",), ("x" * 300,)], "v string").select(text.safe_component(F.col("v")).alias("c"), text.ascii_folded(F.col("v")).alias("f")).collect()
    assert names[0].c == "ok-1.2" and names[1].c.startswith("a_b-") and names[2].c.startswith("id-") and names[3].c.startswith("é_ü-") and names[3].f == "e u" and len(names[4].c) == 96 + 13


def test_tasks_grow_in_number_with_the_rows(spark, sf, monkeypatch):
    from stratafolio.operators import storage
    from stratafolio.plans import QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert storage.dealt(lines, "l_orderkey").rdd.getNumPartitions() == lines.rdd.getNumPartitions()
    few = sorted(map(tuple, QUERIES["ret9_package_claims"](spark, sf).collect()))
    monkeypatch.setattr(storage, "ROWS_A_TASK", 300)
    assert storage.dealt(lines, "l_orderkey").rdd.getNumPartitions() == lines.count() // 300
    assert few and sorted(map(tuple, QUERIES["ret9_package_claims"](spark, sf).collect())) == few
