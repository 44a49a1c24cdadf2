import datetime
import hashlib

from pyspark.sql import functions as F

from stratafolio.functions import content
from stratafolio.operators import evidence
from stratafolio.sources import publish

DAY = datetime.datetime


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


BLOCK = "block_id string, extraction_id string, ordinal int, text string, table array<array<string>>, header_rows int"


def test_a_block_with_its_context_projection_and_table(spark):
    rows = [["name", "value"], ["a", "1,234"], ["b", "(5%)"]]
    damaged = "\x01\x02\x03\x04\x05"
    blocks = spark.createDataFrame([("b0", "e", 0, damaged, None, None), ("b1", "e", 1, "raw 998877", rows, 1), ("b2", "e", 2, "next", None, None), ("b3", "e", 3, "last", None, None)], BLOCK)
    stored = spark.createDataFrame([("p1", "b1", sha("raw 998877"), "raw"), ("p2", "b2", sha("next"), "NEXT"), ("old", "b3", sha("older"), "x")], "projection_id string, block_id string, text_sha256 string, projected_text string")
    heads = spark.createDataFrame([("b2", "p2")], "block_id string, projection_id string")
    wanted = spark.createDataFrame([("b1", None), ("b1", "p1"), ("b2", "p1"), ("b3", "old"), ("b3", None), ("zz", None)], "block_id string, projection_id string")
    every = evidence.evidence_context(wanted, blocks, stored, heads).collect()
    assert len(every) == 5
    got = {(r.block_id, r.selection, r.projection_id): r for r in every}
    one = got["b1", "current", None]
    assert (one.text, one.shown, one.before, one.after, one.error) == ("raw 998877", "raw 998877", damaged, "next", None)
    assert [(x.row, x.column, x.is_header, x.text) for x in one.cells][:3] == [(0, 0, True, "name"), (0, 1, True, "value"), (1, 0, False, "a")] and one.cells[3].value == 1234
    two = got["b1", "explicit", "p1"]
    assert (two.text, two.shown, two.before, two.after) == ("raw", "raw", None, "NEXT")
    assert got["b3", "current", None].text == "last"
    errors = {r.block_id: (r.text, r.error) for r in evidence.evidence_context(wanted.where("projection_id IN ('old') OR block_id = 'b2'"), blocks, stored, heads).collect()}
    assert errors == {"b2": (None, "projection does not belong to this block"), "b3": (None, "projection source changed")}
    assert evidence.evidence_context(wanted.where("block_id = 'zz'"), blocks, stored, heads).collect() == []


def test_evidence_of_an_entity(spark):
    key = "source string, doc_id string"
    docs = spark.createDataFrame([("E", "s", f"d{k}") for k in range(4)] + [("F", "s", "d0")], f"entity string, {key}")
    versions = spark.createDataFrame([("s", f"d{k}", "v2", DAY(2020, 1, 1 + k), True) for k in range(4)] + [("s", "d3", "v1", DAY(2021, 1, 1), False)], f"{key}, version_id string, synced_at timestamp, is_current boolean")
    extractions = spark.createDataFrame([("s", f"d{k}", "v2", f"e{k}", 1) for k in range(4)] + [("s", "d3", "v2", "e9", 2)], f"{key}, version_id string, extraction_id string, ingest_seq int")
    blocks = spark.createDataFrame([(e, o, f"{e}-{o}", 1, t) for e in ("e0", "e1", "e2", "e3", "e9") for o, t in enumerate([" ", "fine", "\x01\x02\x03\x04\x05", "more"])], "extraction_id string, ordinal int, block_id string, page int, text string")
    analyses = spark.createDataFrame([("r1", "s", "d3", "v2", "m", "done", "draft 1", DAY(2020, 1, 1)), ("r2", "s", "d2", "v2", "m", "done", "draft 2", DAY(2020, 2, 1)), ("r3", "s", "d2", "v2", "m", "done", "stale", DAY(2020, 3, 1)), ("r4", "s", "d2", "v2", "m", "failed", "no", DAY(2020, 4, 1)), ("r5", "s", "d3", "v1", "m", "done", "of an old version", DAY(2020, 4, 1))], f"run_id string, {key}, version_id string, model_identity string, status string, draft string, finished_at timestamp")
    claim = "entity string, claim_id string, revision int, statement string, status string, evidence string, counterevidence string, updated_at timestamp"
    claims = spark.createDataFrame([("E", "c1", 1, "one", "accepted", '[{"block_id": "b1"}]', None, DAY(2020, 1, 1)), ("E", "c2", 3, "two", "proposed", None, "[]", DAY(2020, 1, 2)), ("E", "c3", 2, "stale", "accepted", None, None, DAY(2020, 1, 3)), ("E", "c4", 1, "outdated", "accepted", '[{"block_id": "b2"}]', None, DAY(2020, 1, 4))], claim)
    stale = spark.createDataFrame([("analysis", "r3"), ("claim", "c3@2"), ("claim", "c2@1")], "kind string, object_id string")
    cited = spark.createDataFrame([("b1", "e", "s", "d", "v", False), ("b2", "e", "s", "d", "v", False)], "block_id string, extraction_id string, source string, doc_id string, version_id string, risky boolean")
    heads = spark.createDataFrame([("b2", "p")], "block_id string, projection_id string")
    allowed = spark.createDataFrame([("s", d) for d in ("d0", "d1", "d3")], key)
    run = lambda **more: [(r.entity, r.n, r.kind, r.block_id or r.run_id or r.claim_id) for r in evidence.entity_evidence(docs, versions, extractions, blocks, analyses, claims, stale, cited, heads, **more).orderBy("entity", "n").collect()]
    assert run(docs=2, blocks_a_doc=2) == [("E", 1, "document_block", "e9-1"), ("E", 2, "document_block", "e2-1"), ("E", 3, "analysis", "r2"), ("E", 4, "analysis", "r1"), ("E", 5, "claim", "c2"), ("E", 6, "claim", "c1"), ("F", 1, "document_block", "e0-1")]
    assert run(docs=2, most_analyses=1, most_claims=3, allowed=allowed) == [("E", 1, "document_block", "e9-1"), ("E", 2, "document_block", "e9-3"), ("E", 3, "analysis", "r1"), ("E", 4, "claim", "c2"), ("F", 1, "document_block", "e0-1"), ("F", 2, "document_block", "e0-3")]


def test_an_outbox_is_consumed_when_its_notes_are_there(spark):
    outbox = spark.createDataFrame([(1, "e1", "pending"), (2, "e1", "consumed"), (3, "e2", "pending"), (4, "e3", "pending"), (5, "e1", "pending")], "id int, extraction_id string, status string")
    notes = spark.createDataFrame([("n1", "c1", "e1"), ("n2", "c2", "e2"), ("n9", "c9", "e9")], "name string, content string, extraction_id string")
    due = publish.notes_to_write(outbox, notes)
    assert sorted(r.name for r in due.collect()) == ["n1", "n2"]
    after = publish.consumed(outbox, due.where("name = 'n1'"))  # the second write was cut
    assert {r.id: r.status for r in after.collect()} == {1: "consumed", 2: "consumed", 3: "pending", 4: "pending", 5: "consumed"}
    assert [r.name for r in publish.notes_to_write(after, notes).collect()] == ["n2"]


def test_manifests_with_nulls(spark):
    region = "array<struct<id:string,kind:string,bbox:array<double>,asset:struct<sha256:string,name:string>,caption:string>>"
    kind = f"policy string, review_state string, reviewer string, source string, doc_id string, version_id string, extraction_id string, snapshot_sha256 string, text_sha256 string, page int, mapping_method string, coordinate_system string, regions {region}"
    good = (content.POLICY, "confirmed", "r", "s", "d", "v", "e", "x", sha("text"), 1, content.MAPPINGS[1], content.COORDINATES)
    full = [0.0, 0.0, 1.0, 1.0]
    cases = {
        "good": (*good, [("a", "table", full, None, None)]), "no reviewer": (*good[:2], None, *good[3:], [("a", "table", full, None, None)]), "no regions": (*good, None), "no id": (*good, [(None, "table", full, None, None)]),
        "no box": (*good, [("a", "table", None, None, None)]), "nan": (*good, [("a", "table", [0.0, 0.0, float("nan"), 1.0], None, None)]), "flat": (*good, [("a", "table", [0.5, 0.0, 0.5, 1.0], None, None)]), "no image": (*good, [("a", "chart", full, None, "text")]),
        "no caption": (*good, [("a", "chart", full, ("a" * 64, "a" * 64 + ".png"), None)]), "chart": (*good, [("a", "chart", full, ("a" * 64, "a" * 64 + ".png"), "ex")]), "null page": (*good[:9], None, *good[10:], [("a", "table", full, None, None)]),
    }
    frame = spark.createDataFrame([(k, v) for k, v in cases.items()], f"k string, m struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    block = F.struct(*(F.lit(v).alias(n) for n, v in zip(("source", "doc_id", "version_id", "extraction_id", "snapshot_sha256", "page", "text"), ("s", "d", "v", "e", "x", 1, "text"))))
    got = {r.k: r.e for r in frame.select("k", content.manifest_error(F.col("m"), block).alias("e")).collect()}
    assert got == {"good": None, "no reviewer": "projection requires confirmed reviewer and policy", "no regions": "regions required", "no id": "duplicate or missing region id", "no box": "invalid bbox", "nan": "invalid bbox", "flat": "bbox outside page", "no image": "chart image required", "no caption": "caption must be an exact source-text excerpt", "chart": None, "null page": "physical page mismatch"}


class Busy(Exception):
    retryable = True


def test_providers_ask_only_with_permission_and_try_again(spark):
    import pytest

    from stratafolio.sources import registries

    calls = {}

    def answer(prompt):
        calls[prompt] = calls.get(prompt, 0) + 1
        if prompt == "busy" and calls[prompt] < 2:
            raise Busy("later")
        if prompt == "always":
            raise Busy("later")
        if prompt == "bad":
            raise ValueError("no")
        return prompt[::-1]

    registries.PROVIDERS.register("mirror", answer)
    frame = spark.createDataFrame([("abc",), ("busy",), ("always",), ("bad",), (None,)], "p string").coalesce(1)
    with pytest.raises(PermissionError, match="egress_allowed=false"):
        registries.completed(frame, ["p"], "p", "mirror")
    with pytest.raises(LookupError, match="unknown provider"):
        registries.completed(frame, ["p"], "p", "nobody", egress_allowed=True)
    got = {r.p: (r.answer, r.error, r.attempts) for r in registries.completed(frame, ["p"], "p", "mirror", egress_allowed=True, attempts=3).collect()}
    assert got == {"abc": ("cba", None, 1), "busy": ("ysub", None, 2), "always": (None, "Busy: later", 3), "bad": (None, "ValueError: no", 1), None: ("", None, 1)}


def test_a_retriever_cannot_show_what_the_gate_holds_back(spark):
    from stratafolio.operators import search
    from stratafolio.sources import registries

    blocks = spark.createDataFrame([("b1", "fine"), ("b2", "\x01\x02\x03\x04\x05"), ("b3", "also")], "block_id string, text string")
    hits = spark.createDataFrame([(1, 1, "b2"), (1, 2, "b1"), (1, 2, "b1"), (1, 3, "gone"), (1, 4, "b3")], "query_id int, rank int, block_id string")
    registries.RETRIEVERS.register("fixed", lambda queries, blocks, k: hits)
    queries = spark.createDataFrame([(1, "q")], "query_id int, query string")
    assert [(r.rank, r.block_id, r.text) for r in registries.retrieved(queries, blocks, "fixed", 5, search.gate).orderBy("rank").collect()] == [(1, "b1", "fine"), (2, "b3", "also")]


def test_texts_around_a_block_are_moved_few_times(spark):
    from stratafolio.operators.storage import written

    from .shuffled import moved

    noise = lambda k: "".join(hashlib.sha512(f"{k}/{j}".encode()).hexdigest() for j in range(16))
    blocks = written(spark.createDataFrame([(f"{d}-{k}", str(d), k, noise(f"{d}-{k}"), None, None) for d in range(60) for k in range(20)], BLOCK))
    stored = written(blocks.where("ordinal % 2 = 0").select(F.concat(F.lit("p"), "block_id").alias("projection_id"), "block_id", F.sha2("text", 256).alias("text_sha256"), F.lit("seen").alias("projected_text")))
    wanted = blocks.select("block_id", F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("p"), "block_id")).when(F.col("ordinal") % 4 == 1, "nowhere").alias("projection_id"))
    with moved(spark) as seen:
        out = evidence.evidence_context(wanted, blocks, stored, stored.select("block_id", "projection_id")).collect()
    assert seen["bytes"] < 4 * 60 * 20 * 2048
    got = {r.block_id: r for r in out}
    assert len(out) == 1200 and (got["7-4"].text, got["7-4"].before, got["7-4"].after) == ("seen", noise("7-3"), noise("7-5"))
    assert (got["7-1"].text, got["7-1"].error, got["7-1"].before, got["7-1"].after) == (None, "projection does not belong to this block", "seen", "seen")
    assert (got["7-2"].text, got["7-2"].shown, got["7-2"].before) == (noise("7-2"), "seen", noise("7-1"))
