import json

from stratafolio.operators import currency, projections

REQUEST = projections.REQUEST


def test_chains_of_three_hops_and_cycles(spark):
    edges = [("claim", "block"), ("summary", "claim"), ("page", "summary"), ("a", "page"), ("page", "a"), ("other", "else"), ("both", "block"), ("both", "summary"), (None, "block"), ("x", None), ("claim", "block")]
    got = {r.id: (r.hops, r.reason) for r in currency.stale(spark.createDataFrame(edges, "id string, cites string"), spark.createDataFrame([("block",), (None,)], "id string")).collect()}
    assert got == {"claim": (1, currency.CHANGED), "both": (1, currency.CHANGED), "summary": (2, currency.DEPENDENCY), "page": (3, currency.DEPENDENCY), "a": (4, currency.DEPENDENCY)}


def test_a_changed_object_in_a_cycle_and_nothing_changed(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, cites string")
    assert {r.id: r.hops for r in currency.stale(edges, spark.createDataFrame([("a",)], "id string")).collect()} == {"b": 1, "a": 2}
    assert currency.stale(edges, spark.createDataFrame([], "id string")).collect() == []
    assert currency.stale(edges.limit(0), spark.createDataFrame([("a",)], "id string")).collect() == []


def test_long_chains_are_compacted(spark):
    edges = spark.createDataFrame([(k, k - 1) for k in range(1, 20)], "id long, cites long")
    assert {r.id: r.hops for r in currency.stale(edges, spark.createDataFrame([(0,)], "id long")).collect()} == {k: k for k in range(1, 20)}


def test_invalidation_follows_nested_references(spark):
    blocks = spark.createDataFrame([("b1", "e1"), ("b2", "e1"), ("b3", "e2")], "block_id string, extraction_id string")
    objects = spark.createDataFrame([("claim", "c1@1", json.dumps([{"inner": [{"block_id": "b1"}]}])), ("claim", "c2@1", json.dumps({"block_id": "b3"})), ("analysis", "r1", json.dumps({"extraction_id": "e1"})), ("claim", "c3@1", "no json"), ("claim", "c4@1", None)], "kind string, object_id string, evidence string")
    references = spark.createDataFrame([("summary", "s1", "claim", "c1@1"), ("summary", "s2", "analysis", "r1"), ("summary", "s3", "claim", "c2@1"), ("page", "p1", "summary", "s1")], "kind string, object_id string, cited_kind string, cited_id string")
    got = {(r.kind, r.object_id): r.hops for r in currency.invalidated(spark.createDataFrame([("b1",)], "block_id string"), blocks, objects, references).collect()}
    assert got == {("claim", "c1@1"): 1, ("analysis", "r1"): 1, ("summary", "s1"): 2, ("summary", "s2"): 2, ("page", "p1"): 3}


def test_current_evidence(spark):
    blocks = spark.createDataFrame([("b1", "e1", "s", "d1", "v1", False), ("b2", "e1", "s", "d1", "v1", True), ("b3", "e2", "s", "d2", "v1", False), ("b4", "e3", "s", "d2", "v2", False)], "block_id string, extraction_id string, source string, doc_id string, version_id string, risky boolean")
    heads = spark.createDataFrame([("b3", "p3")], "block_id string, projection_id string")
    cases = {
        "raw block without a head": ({"block_id": "b1"}, True, True),
        "projection that is the head": ([{"x": [{"block_id": "b3", "projection_id": "p3"}]}], True, True),
        "raw block that has a head": ({"block_id": "b3"}, False, False),
        "an old projection": ({"a": {"block_id": "b3", "projection_id": "p2"}}, False, False),
        "projection of a block without one": ({"block_id": "b1", "projection_id": "p1"}, False, False),
        "risky block": ({"block_id": "b2"}, True, False),
        "extraction with a risky block": ({"extraction_id": "e1"}, True, False),
        "extraction with a head": ({"extraction_id": "e2"}, False, False),
        "document with a head": ({"source": "s", "doc_id": "d2"}, False, False),
        "version without a head": ({"source": "s", "doc_id": "d2", "version_id": "v2"}, True, True),
        "unknown": ([{"block_id": "zz"}, {"extraction_id": "zz"}], True, True),
        "one bad of several": ([{"block_id": "b1"}, {"y": {"block_id": "b3"}}], False, False),
        "nothing": ({}, True, True),
    }
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("null", None), ("no json", "{")]
    objects = spark.createDataFrame(rows, "object string, evidence string")
    for hold in (False, True):
        got = {r.object: r.current for r in currency.current_evidence(objects, blocks, heads, hold).collect()}
        assert got == {k: v[1 + hold] for k, v in cases.items()} | {"null": True, "no json": True}


def replay(spark, log, requests):
    rows = projections.replayed(spark.createDataFrame(log, "block_id string, event_id long, old_projection_id string, new_projection_id string"), spark.createDataFrame(requests, REQUEST)).collect()
    return {(r.block_id, r.sequence): (r.outcome, r.old_projection_id, r.new_projection_id, r.revision) for r in rows}


def test_rollback_goes_to_the_previous_projection(spark):
    log = [("b", 1, None, "p1"), ("b", 2, "p1", "p2"), ("c", 3, None, "q")]
    got = replay(spark, log, [("b", 1, "rollback", None, "wrong", None), ("b", 2, "rollback", None, "p2", None), ("b", 3, "rollback", None, "p1", None), ("c", 1, "rollback", None, "q", None), ("c", 2, "rollback", None, "q", None), ("d", 1, "rollback", None, None, None)])
    assert got == {
        ("b", 1): ("conflict", "p2", "p2", 2), ("b", 2): ("rolled_back", "p2", "p1", 3), ("b", 3): ("rolled_back", "p1", "p2", 4),
        ("c", 1): ("rolled_back", "q", None, 2), ("c", 2): ("conflict", None, None, 2), ("d", 1): ("conflict", None, None, 0),
    }


def test_later_valid_requests_win(spark):
    requests = [("b", 1, "activate", "p1", None, 3), ("b", 2, "activate", "p1", None, 0), ("b", 3, "activate", "p1", None, None), ("b", 4, "activate", "p2", "", None), ("b", 5, "activate", "p2", "p1", None), ("b", 6, "erase", "p2", None, None), ("b", 7, "activate", None, None, None)]
    got = [v for _, v in sorted(replay(spark, [], requests).items())]
    assert got == [("conflict", None, None, 0), ("activated", None, "p1", 1), ("unchanged", "p1", "p1", 1), ("conflict", "p1", "p1", 1), ("activated", "p1", "p2", 2), ("invalid", "p2", "p2", 2), ("invalid", "p2", "p2", 2)]


def test_a_request_that_expects_too_little_keeps_no_other_from_winning(spark):
    """Head revision 4, requests expecting 3 and 4."""
    heads = spark.createDataFrame([("b", 4, "old")], "block_id string, revision int, projection_id string")
    requests = spark.createDataFrame([("b", 3, "x"), ("b", 4, "y"), ("b", 5, None), ("c", 0, "z")], "block_id string, expected int, projection_id string")
    got = {(r.block_id, r.outcome, r.projection_id, r.revision) for r in projections.activated(heads, requests).collect()}
    assert got == {("b", "conflict", "old", 4), ("b", "activated", "y", 5), ("b", "rolled_back", None, 6), ("c", "activated", "z", 1)}


def test_projected_blocks_refuse_what_does_not_fit(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    blocks = spark.createDataFrame([(k, f"text {k}", k) for k in "abcde"], "block_id string, text string, more string")
    stored = spark.createDataFrame([("pa", "a", sha("text a"), "A"), ("pb", "b", sha("older"), "B"), ("pc", "z", sha("text c"), "C")], "projection_id string, block_id string, text_sha256 string, projected_text string")
    heads = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("c", "pc"), ("d", None), ("e", "lost")], "block_id string, projection_id string")
    got = {r.block_id: (r.text, r.projection_id, r.error) for r in projections.projected_blocks(blocks, stored, heads).collect()}
    assert got == {"a": ("A", "pa", None), "b": (None, None, "projection source changed"), "c": (None, None, "projection does not belong to this block"), "d": ("text d", None, None), "e": (None, None, "projection does not belong to this block")}
