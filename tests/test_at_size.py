"""Queries against their SQL on small tables of what only large ones hold."""

import datetime

import duckdb

from stratafolio.plans import ORACLES, QUERIES


def tables(spark, folder, **rows):
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def differences(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    out = con.execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    want = {repr(r) for r in out.fetchall()}
    got = {repr(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, str(folder)).collect()}
    assert want
    return sorted(got ^ want)


def test_html_text_leaves_names_that_are_cut_off(spark, tmp_path):
    tables(spark, tmp_path, pages=([(1, "u", "<title>ver&amp</title><p>R&amp;D &copy; &amp &amp;amp;</p>")], "page_id long, url string, html string"))
    assert differences(spark, tmp_path, "str10_html_text") == []


def test_sizes_in_the_middle_go_to_the_even_side(spark, tmp_path):
    tables(spark, tmp_path, pages=([(k, "https://a.org/x", "x" * n) for k, n in enumerate((1023, 2304, 2406, 2560, 3328, 10189))], "page_id long, url string, html string"))
    assert differences(spark, tmp_path, "str14_names") == []


def test_capitals_are_one_letter_each(spark, tmp_path):
    tables(spark, tmp_path, conversations=([(1, 0, "straße x"), (2, 0, "ŉﬁǰᾳdžß"), (3, 0, None)], "conv_id long, turn int, text string"))
    assert differences(spark, tmp_path, "udf4_completions") == []


def test_first_lines_of_parts_over_a_million(spark, tmp_path):
    day = datetime.datetime(1995, 1, 1)
    lines = [(o, n, p, 1) for o in (1, 2, 3) for n, p in ((1, 1_950_001), (1, 1_150_001), (2, 100_001), (3, 10))]
    tables(spark, tmp_path, orders=([(o, 7, "O", day + datetime.timedelta(o)) for o in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"), part=([(p,) for p in (1_950_001, 1_150_001, 100_001, 10)], "p_partkey long"))
    assert differences(spark, tmp_path, "ret8_entity_evidence_items") == []


def test_lines_of_one_part_are_told_apart_by_their_supplier(spark, tmp_path):
    day = datetime.datetime(1995, 1, 1)
    lines = [(o, 1, 10, s) for o in range(1, 9) for s in ((900, 31, 700, 5) if o % 2 else (5, 700, 31, 900))]
    tables(spark, tmp_path, orders=([(o, o, "O", day) for o in range(1, 9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"), part=([(10,)], "p_partkey long"))
    shown = {(r.entity, r.what) for r in QUERIES["ret8_entity_evidence_items"](spark, str(tmp_path)).where("kind = 'document_block'").collect()}
    assert shown == {(o, f"1-10-{s}") for o in range(1, 9) for s in (5, 31)}


def test_best_blocks_are_those_of_all_scores(spark, tmp_path, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from stratafolio.operators import index, retrieval

    r = random.Random(3)
    lines = [(k, 0, f"b{k % 97}-{k}", " ".join(r.choices("abcdefgh", k=r.randint(1, 6)))) for k in range(400)]
    blocks = spark.createDataFrame(lines, "doc_id long, ordinal int, block_id string, text string")
    store = index.IndexStore(spark, str(tmp_path / "store"))
    name, _ = store.build(blocks, term_buckets=2)
    queries = spark.createDataFrame([(q, t) for q, ts in (("x", "ab"), ("y", "bcdz"), ("z", "h"), ("none", "z")) for t in ts], "query_id string, term string")
    allowed = blocks.where("doc_id % 3 > 0").select("block_id")
    rows = lambda df: sorted((x.query_id, x["rank"], x.block_id, round(x.score, 6), *([sorted(x.terms)] if "terms" in df.columns else [])) for x in df.collect())
    for cells, seen in ((12, None), (100, allowed), (1 << 20, allowed)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        plain = retrieval.bm25(store.postings(name), store.blocks(name), queries, seen, store.sizes(name), terms=True).withColumn("score", F.round("score", 6))
        want = rows(retrieval.top(plain, ["query_id"], 7, F.desc("score"), F.asc("block_id")))
        assert len(want) == 21
        for few in (100_000, 1):
            monkeypatch.setattr(retrieval, "FEW_TERMS", few)
            assert rows(retrieval.best(store.postings(name), store.blocks(name), queries, 7, 6, seen, store.sizes(name), terms=True)) == want


def test_scores_hand_on_no_more_than_the_first_of_each_query():
    import numpy as np
    import pyarrow as pa

    from stratafolio.operators import retrieval

    rows = [(f"b{b:04}", t, 1.0 + (b * 7 + t) % 5) for b in range(500) for t in (0, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 33])], names=["block_id", "t", "weight"]) for at in range(0, len(rows), 33)]
    out = [b for b in retrieval._scored(iter(batches), 2, np.array([0, 2, 3]), np.array([0, 1, 1]), None, 4, 6)]
    assert sum(b.num_rows for b in out) == 8  # of 1,000 pairs


def test_each_task_of_a_build_writes_one_file_of_few_postings(spark, tmp_path, monkeypatch):
    from stratafolio.operators import index

    monkeypatch.setattr(index, "POSTINGS_A_FILE", 50)
    words = [f"w{k}" for k in range(40)]
    blocks = spark.createDataFrame([(k, 0, f"b{k}", " ".join(words)) for k in range(100)], "doc_id long, ordinal int, block_id string, text string")
    store = index.IndexStore(spark, str(tmp_path / "store"))
    name, _ = store.build(blocks)
    sizes = [r["count"] for r in store.postings(name).selectExpr("input_file_name() AS f").groupBy("f").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 60 and max(sizes) < 250


def test_all_pages_of_a_long_document_are_recognised(spark, tmp_path):
    tables(spark, tmp_path, documents=([(1, "\n".join(["short"] * 450 + ["a line that is long enough"] * 3)), (2, "x\ny")], "doc_id long, text string"))
    assert differences(spark, tmp_path, "arr3_page_states") == []


def test_nodes_of_large_evidence_are_handed_on_in_pieces():
    import json

    import pyarrow as pa

    from stratafolio.operators import currency

    text = json.dumps({"inner": [[{"source": "s", "doc_id": str(k)} for k in range(25_000)]]})
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d"]), pa.array([text, text, "{", None])], names=["object", "evidence"])
    found = list(currency._nodes(iter([batch])))
    assert max(b.num_rows for b in found) <= 10_000
    rows = [(o, d) for b in found for o, d in zip(b.column(0).to_pylist(), b.column(5).to_pylist())]
    assert sorted(rows) == sorted((o, str(k)) for o in "ab" for k in range(25_000))


def test_pages_of_any_characters(spark, tmp_path):
    tables(spark, tmp_path, documents=([(1, "smile \U0001f600\nplain (a\\b)\n\n漢字 \U00020000 end"), (2, "x")], "doc_id long, text string"))
    assert differences(spark, tmp_path, "arr3_pdf_pages") == []


def long_items(spark, folder):
    """Two items whose last words lie behind 2,000 characters, and documents that have no other word of theirs; orders of the documents, half of them late."""
    filler = " ".join(f"filler{k}" for k in range(400))
    items = [(0, f"{filler} Quince quince behind"), (1, f"first {filler} medlar")]
    texts = ["a quince\nquince and medlar", "medlar behind\nfirst", "nothing of these", "quince quince behind filler1"]
    orders = [(k, datetime.datetime(1996 + k % 2, 1, 1)) for k in range(4)]
    tables(spark, folder, benchmark=(items, "item_id long, text string"), documents=(list(enumerate(texts)), "doc_id long, text string"), orders=(orders, "o_orderkey long, o_orderdate timestamp_ntz"))


def test_batch_search_uses_whole_items(spark, tmp_path):
    long_items(spark, tmp_path)
    for name in ("ret1_bm25_batch", "ret1_bm25_search", "ret2_stale_terms", "ret2_guarded_search"):
        assert differences(spark, tmp_path, name) == [], name


def test_as_of_search_uses_whole_items(spark, tmp_path):
    long_items(spark, tmp_path)
    for name in ("ret3_as_of_hits", "ret3_as_of_versions"):
        assert differences(spark, tmp_path, name) == [], name


def test_a_task_hands_on_no_more_than_the_first_of_each_query(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from stratafolio.operators import retrieval

    monkeypatch.setattr(retrieval, "CELLS", 40)  # 20 blocks at a time
    rows = [(f"b{b:04}", t, 1.0 + (b * 7 + t) % 5) for b in range(500) for t in (0, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 33])], names=["block_id", "t", "weight"]) for at in range(0, len(rows), 33)]
    out = [r for b in retrieval._scored(iter(batches), 2, np.array([0, 2, 3]), np.array([0, 1, 1]), ["x", "y"], 4, 6) for r in b.to_pylist()]
    sums = [[(-sum(w for b, t, w in rows[2 * k : 2 * k + 2] if t in of), rows[2 * k][0]) for k in range(500)] for of in ((0,), (0, 1))]
    assert sorted((r["q"], -r["score"], r["block_id"]) for r in out) == sorted((q, *x) for q in (0, 1) for x in sorted(sums[q])[:4])
    assert {(r["q"], tuple(r["terms"])) for r in out} == {(0, ("x",)), (1, ("x", "y"))}


def test_only_queries_that_lack_hits_are_searched_again(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from stratafolio.operators import index, retrieval, search

    blocks = spark.createDataFrame([(k, 0, f"b{k:03d}", f"{'word' if k < 60 else 'other'} more") for k in range(80)], "doc_id long, ordinal int, block_id string, text string")
    store = index.IndexStore(spark, str(tmp_path / "index"))
    name, _ = store.build(blocks, term_buckets=2)
    now = blocks.withColumn("text", F.when(F.col("doc_id") < 40, "gone").otherwise(F.col("text")))
    asked, best = [], retrieval.best
    monkeypatch.setattr(retrieval, "best", lambda i, b, queries, *a, **k: asked.append(sorted(r.term for r in queries.collect())) or best(i, b, queries, *a, **k))
    found = search.search(store, name, spark.createDataFrame([(0, "word"), (1, "other")], "query_id int, term string"), now, 5).collect()
    assert sorted((r.query_id, r["rank"], r.block_id) for r in found) == [(0, k + 1, f"b{40 + k:03d}") for k in range(5)] + [(1, k + 1, f"b{60 + k:03d}") for k in range(5)]
    assert asked == [["other", "word"], ["word"], ["word"]]
