import zlib

from pyspark.sql import functions as F

from stratafolio.operators import history, index, queues, selection
from stratafolio.operators.retrieval import bm25, nearest
from stratafolio.sources import documents, files


def test_effective_extraction(spark):
    extractions = spark.createDataFrame([("v", "old", "ready", 2, 0, 1), ("v", "new", "ready", 2, 0, 2), ("w", "only", "review", 0, 0, 3), ("x", "gone", "failed", 0, 0, 4), ("y", "gap", "ready", 3, 0, 5)], "version string, extraction_id string, status string, pages int, missing_pages int, ingest_seq long")
    blocks = spark.createDataFrame([("old", "good", 1, "ready"), ("old", "good", 2, "ready"), ("new", "good", 1, "ready"), ("new", "\x01\x02\x03\x04", 2, "ready"), ("only", "fine", None, "review"), ("gone", "text", 1, "ready"), ("gap", "a", 1, "ready"), ("gap", " ", 2, "ready")], "extraction_id string, text string, page int, block_status string")
    got = {r.version: (r.extraction_id, r.tier, r.is_newest) for r in selection.effective_extractions(extractions, blocks).collect()}
    assert got == {"v": ("old", 0, False), "w": ("only", 1, True), "y": ("gap", 1, True)}


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (1, 1), (2, 7)], "k int, at int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 5, "c"), (1, None, "d")], "k int, since int, v string")
    got = sorted(tuple(r) for r in selection.as_of_join(left, right, ["k"], "at", "since", "v").select("k", "at", "v").collect())
    assert got == [(1, 1, None), (1, 5, "c"), (1, 10, "c"), (2, 7, None)]


def test_generation_lifecycle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat\nthe dog"), (2, "a cat")], "doc_id long, text string")
    store = index.IndexStore(spark, str(tmp_path / "index"))
    assert store.active() is None
    blocks = index.line_blocks(docs)
    name, built = store.build(blocks)
    assert built and store.active() == name and store.build(blocks) == (name, False)
    rows = {(r.term, r.block_id): r.tf for r in store.postings_of(["cat", "the"], name).collect()}
    assert rows == {("cat", "1-b0000"): 1, ("cat", "2-b0000"): 1, ("the", "1-b0000"): 1, ("the", "1-b0001"): 1}
    other, _ = store.build(index.line_blocks(docs.where("doc_id = 1")))
    assert other != name and store.active() == other
    q = spark.createDataFrame([(0, "cat")], "query_id int, term string")
    best = bm25(store.postings_of(["cat"], name), store.blocks(name), q).orderBy(F.desc("score")).first()
    assert best.block_id == "2-b0000"


def test_nearest_has_full_recall(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    got = nearest(vectors, vectors.where("id < 3").withColumnRenamed("id", "query_id"), 4).collect()
    assert len(got) == 12 and all(r.similarity > 0.9999 for r in got if r.rank == 1)


def test_change_events(spark):
    d = spark.createDataFrame([("a", True, "title", True, False, "v1", "v2"), ("b", False, "", False, True, None, "v1")], "doc_id string, known_before boolean, changed_fields string, was_available boolean, available boolean, old_current string, new_current string")
    v = spark.createDataFrame([("a", "v2", True, "conflict", None), ("b", "v1", True, "ready", None)], "doc_id string, version_id string, is_new boolean, state string, old_state string")
    got = sorted((r.doc_id, r.kind, r.detail) for r in history.change_events(d, v).collect())
    assert got == [("a", "became_unavailable", ""), ("a", "content_conflict", "v2"), ("a", "current_changed", "v1>v2"), ("a", "metadata_updated", "title"), ("a", "new_version", "1"), ("b", "new_version", "1")]


def test_empty_snapshot_marks_nothing_absent(spark):
    before = spark.createDataFrame([(1, "x")], "k int, v string")
    assert history.snapshot_diff(before, before.limit(0), ["k"], ["v"]).count() == 0


def test_budget_and_outbox(spark):
    r = spark.createDataFrame([(1, 1, 80.0), (1, 2, 50.0), (1, 3, 10.0), (1, 4, None), (2, 1, 101.0)], "a int, o int, x double")
    got = queues.within_cap(r, ["a"], "o", "x", 100.0).orderBy("a", "o").collect()
    assert [x.granted for x in got] == [True, False, True, True, False]


def test_html_extraction():
    page = b"<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><h1>Head &amp; more</h1><p>One<br>two <b>bold</b><p>Open<table><tr><th>H</th><td>1</td></tr></table><script>var a;</script></body></html>"
    got = [(b["block_type"], b["text"]) for b in documents.html_blocks(page)]
    assert got == [("heading", "T"), ("heading", "Head & more"), ("paragraph", "One two bold"), ("paragraph", "Open"), ("table", "H"), ("table", "1")]


def test_text_offsets():
    raw = "one\n\n  two lines\nhere \n \nthree"
    for b in documents.text_blocks(raw.encode()):
        assert raw[b["start_char"] : b["end_char"]] == b["text"]
    assert [b["text"] for b in documents.text_blocks(raw.encode())] == ["one", "two lines\nhere", "three"]


def test_pdf_extraction():
    stream = zlib.compress(b"BT (Second \\(page\\)) Tj <48 69> Tj ET")
    pdf = b"%PDF\n1 0 obj <</Type /Pages /Kids [3 0 R 2 0 R]>> endobj\n2 0 obj <</Type /Page /Parent 1 0 R /Contents 5 0 R>> endobj\n3 0 obj <</Type /Page /Parent 1 0 R /Contents 4 0 R>> endobj\n4 0 obj <</Length 9>> stream\nBT (First) Tj ET\nendstream endobj\n5 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj"
    assert [(b["page"], b["text"]) for b in documents.pdf_blocks(pdf)] == [(1, "First"), (2, "Second (page)\nHi")]


def test_blobs(spark, tmp_path):
    for name, data in (("a.txt", b"same"), ("b.txt", b"same"), ("c.txt", b"other")):
        (tmp_path / name).write_bytes(data)
    found = files.snapshots(spark, str(tmp_path), "*.txt")
    stored = files.blobs(found)
    assert found.count() == 3 and stored.count() == 2 and files.blobs(found, stored).count() == 0 and files.broken_blobs(stored).count() == 0


def test_quotas():
    assert selection.stratum_quotas([("a", 100), ("b", 10), ("c", 1)], 12) == {"a": 10, "b": 1, "c": 1}
