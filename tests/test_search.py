import hashlib
import math
import random

from pyspark.sql import functions as F

from stratafolio.functions import numbers
from stratafolio.operators import index, search

BLOCKS = "doc_id long, ordinal int, block_id string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(spark, tmp_path, rows):
    blocks = spark.createDataFrame(rows, BLOCKS)
    store = index.IndexStore(spark, str(tmp_path / "index"))
    return store, store.build(blocks)[0], blocks


def asked(spark, *terms):
    return spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")


def hits(*args, **more):
    return [(r.block_id, r.matched, r.projection_id) for r in search.search(*args, **more).orderBy("rank").collect()]


def test_an_old_generation_does_not_leak_retired_terms(spark, tmp_path):
    store, name, blocks = made(spark, tmp_path, [(1, 0, "b1", "revenue grew 998877"), (2, 0, "b2", "revenue fell")])
    stored = spark.createDataFrame([("p1", "b1", sha("revenue grew 998877"), "revenue grew")], "projection_id string, block_id string, text_sha256 string, projected_text string")
    heads = stored.select("block_id", "projection_id")
    assert hits(store, name, asked(spark, "998877"), blocks) == [("b1", ["998877"], None)]
    assert hits(store, name, asked(spark, "998877"), blocks, projections=stored, heads=heads) == []
    assert hits(store, name, asked(spark, "998877", "revenue"), blocks, projections=stored, heads=heads) == [("b1", ["revenue"], "p1"), ("b2", ["revenue"], None)]
    changed = stored.withColumn("text_sha256", F.lit("other"))  # made of another text: shown to nobody
    assert hits(store, name, asked(spark, "revenue"), blocks, projections=changed, heads=heads) == [("b2", ["revenue"], None)]
    gone = blocks.where("doc_id = 2")
    assert hits(store, name, asked(spark, "revenue"), gone) == [("b2", ["revenue"], None)]


def test_held_candidates_are_released_by_a_projection(spark, tmp_path):
    risk = "Figure 2 Axis\n" + "\n".join(map(str, range(30)))
    store, name, blocks = made(spark, tmp_path, [(1, 0, "b1", risk), (2, 0, "b2", "an axis of text")])
    assert [h[0] for h in hits(store, name, asked(spark, "axis"), blocks)] == ["b2", "b1"]
    assert [h[0] for h in hits(store, name, asked(spark, "axis"), blocks, hold=True)] == ["b2"]
    kept = spark.createDataFrame([("p1", "b1", sha(risk), risk)], "projection_id string, block_id string, text_sha256 string, projected_text string")
    assert [h[0] for h in hits(store, name, asked(spark, "axis"), blocks, projections=kept, heads=kept.select("block_id", "projection_id"), hold=True)] == ["b2", "b1"]


def test_candidates_are_taken_until_enough_pass(spark, tmp_path):
    """The best forty have lost their term; the five wanted come from behind them."""
    rows = [(k, 0, f"b{k:03d}", "word" if k < 40 else f"word and {' more' * (k - 39)}") for k in range(60)]
    store, name, blocks = made(spark, tmp_path, rows)
    now = blocks.withColumn("text", F.when(F.col("doc_id") < 40, "gone").otherwise(F.col("text")))
    assert [h[0] for h in hits(store, name, asked(spark, "word"), now, limit=5)] == [f"b{k:03d}" for k in range(40, 45)]
    assert [h[0] for h in hits(store, name, asked(spark, "word"), now, limit=30)] == [f"b{k:03d}" for k in range(40, 60)]
    assert hits(store, name, asked(spark, "absent"), now) == []


def test_a_changed_table_is_never_answered_from_an_old_generation(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    schema = "doc_id long, text string"

    def write(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    def generation():
        return search.current_generation(store, index.line_blocks(spark.read.parquet(path)), search.source_state(spark, path))

    store = index.IndexStore(spark, str(tmp_path / "index"))
    write([(1, "a cat"), (2, "a dog")])
    first, built = generation()
    assert built and generation() == (first, False)
    write([(1, "a cat"), (2, "a bird")])
    second, built = generation()
    assert built and second != first and store.pointer() == {"generation": second, "source": search.source_state(spark, path)}
    assert {r.term for r in store.postings(second).select("term").collect()} == {"a", "cat", "bird"}
    write([(2, "a bird"), (1, "a cat")])  # other files, the same blocks
    assert generation() == (second, False) and store.pointer()["source"] == search.source_state(spark, path)


def test_as_of_by_version(spark):
    blocks = spark.createDataFrame([("b1", 1), ("b2", 2), ("b3", 3), ("b4", 4)], "block_id string, doc_id long")
    versions = spark.createDataFrame([(1, "2020-01-01", None), (2, "2021-01-01", "2019-01-01"), (3, None, "2020-01-01"), (4, None, None)], "doc_id long, first_observed_at string, public_available_at string")
    seen = lambda mode: {r.block_id for r in search.visible_blocks(blocks, versions, F.lit("2020-06-01"), mode).collect()}
    assert seen("system") == {"b1"} and seen("public") == {"b2", "b3"}


def test_selected_blocks(spark):
    versions = spark.createDataFrame([("v1", 1, True), ("v2", 2, False), ("v3", 3, True)], "version string, doc_id long, is_current boolean")
    extractions = spark.createDataFrame([("v1", "e1", "ready", 0, 0, 1), ("v1", "e2", "ready", 0, 0, 2), ("v2", "e3", "ready", 0, 0, 3), ("v3", "e4", "failed", 0, 0, 4)], "version string, extraction_id string, status string, pages int, missing_pages int, ingest_seq long")
    blocks = spark.createDataFrame([("e1", "b1", 0, "fine", None, "ready"), ("e2", "b2", 0, "\x01\x02\x03\x04\x05", None, "ready"), ("e2", "b3", 1, "also fine", None, "ready"), ("e3", "b4", 0, "old", None, "ready"), ("e4", "b5", 0, "text", None, "ready")], "extraction_id string, block_id string, ordinal int, text string, page int, block_status string")
    assert [(r.doc_id, r.block_id, r.text) for r in search.selected_blocks(versions, extractions, blocks).collect()] == [(1, "b1", "fine")]


def test_digest_of_is_of_the_rows_whatever_their_order(spark, monkeypatch):
    rows = [(k, sha(str(k))) for k in range(300)]
    frame = lambda r, n: spark.createDataFrame(r, "k long, d string").repartition(n)
    monkeypatch.setattr(index, "FAN", 8)
    one = index.digest_of(frame(rows, 3), "k", "d")
    random.Random(1).shuffle(rows)
    assert index.digest_of(frame(rows, 5), "k", "d") == one
    assert index.digest_of(frame(rows[1:], 5), "k", "d") != one
    assert index.digest_of(frame(rows[1:] + [(rows[0][0], "x")], 5), "k", "d") != one


def test_half_even_rounds_as_python_does(spark):
    values = [0.125, 0.375, 2.675, 1.00005, 0.00015, -2.5, 1e300, math.nan, None, 12345.67895, 0.5, 1.5]
    frame = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for places in (0, 2, 4, 6):
        got = [r.x for r in frame.select(numbers.half_even(F.col("v"), places).alias("x")).collect()]
        assert repr(got) == repr([None if v is None else round(v, places) for v in values])
