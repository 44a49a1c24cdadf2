import json

import pytest
from pyspark.sql import functions as F

from stratafolio.functions import content, metadata, quality, text
from stratafolio.operators import projections
from stratafolio.sources import documents, pdf, registries


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_json(spark):
    values = ['{"b": 1, "a": [{"block_id": "x"}, {"c": {"extraction_id": "e", "block_id": 3}}]}', "null", "no json", None, '"é"']
    assert each(spark, values, content.canonical_json) == ['{"a":[{"block_id":"x"},{"c":{"block_id":3,"extraction_id":"e"}}],"b":1}', "null", None, None, '"é"']
    assert [[tuple(x) for x in r] for r in each(spark, values, content.json_references)] == [[("block_id", "x"), ("extraction_id", "e")], [], [], [], []]
    deep = json.loads("1")
    for _ in range(300):
        deep = {"x": [deep]}
    assert each(spark, [json.dumps({"d": deep, "block_id": "top"})], content.json_references)[0][0].id == "top"


def test_projection_rules(spark):
    spans = "array<struct<start:int,end:int,sha256:string,action:string,kind:string,role:string,confirmed:boolean>>"
    body = "Figure 1 axis 10 20 prose"
    sha = lambda a, b: __import__("hashlib").sha256(body[a:b].encode()).hexdigest()
    cut = (9, 19, sha(9, 19), "exclude", "chart", "axis", True)
    cases = [[cut], [cut, (0, 9, sha(0, 9), "keep", "narrative", "", None)], [(9, 99, "x", "keep", "chart", "", True)], [(9, 19, "x", "keep", "chart", "", True)], [cut, (18, 20, sha(18, 20), "exclude", "chart", "legend", True)], [cut[:5] + ("other", True)], [cut[:6] + (None,)], []]
    rows = spark.createDataFrame([(k, body, s, ["Figure 1", "axis 10"]) for k, s in enumerate(cases)], f"k int, t string, s {spans}, c array<string>")
    got = [r.p for r in rows.select("k", content.projected(F.col("t"), F.col("s"), F.col("c")).alias("p")).orderBy("k").collect()]
    assert [p.error for p in got] == [None, None, "invalid character span", "span hash mismatch", "overlapping exclusions", "unknown chart fragment role", "only confirmed chart fragments may be excluded", None]
    assert got[0].text == "Figure 1 \n prose\naxis 10" and got[0].excluded_characters == 10 and got[7].text == body


def test_bytes_and_counters(spark):
    assert [tuple(r) for r in each(spark, [b"/Type /Page >> /Type/Page\n/Type /Pages ", b"x", b"/Type /ObjStm /Type /Page "], content.page_count, "binary")] == [(2, "page-object-scan"), (None, "no-page-objects-found"), (None, "object-streams-unsupported")]
    with pytest.raises(LookupError, match="heuristic"):
        content.count_tokens(F.lit("x"), "none")
    assert each(spark, ["", None], lambda v: F.array_max(content.hashed_vector(v))) == [0.0, 0.0]


def test_named_faults(spark):
    assert tuple(each(spark, ["bytes=0-99999999999999999999"], lambda h: metadata.byte_range(h, F.lit(40).cast("long")))[0]) == ("range", 0, 39)
    assert each(spark, ["a\x00b\x07\x7f\n"], text.yaml_scalar) == ['"a\\0b\\x07\\x7f\\n"']
    assert [v.decode("latin-1") for v, _ in pdf.values(b"(a\\8b) (one (two) three) (\\101\\0612) <4a4>(cut\\\nline)")] == ["a8b", "one (two) three", "A12", "J@", "cutline"]
    page = b"<body><nav>menu</nav><p>x</p><footer>foot</footer><script>no</script></body>"
    blocks = documents.EXTRACTORS["html"](page)
    assert [(b["text"], b["dom_path"]) for b in blocks] == [("menu", "body[1]>nav[1]"), ("x", "body[1]>p[1]"), ("foot", "body[1]>footer[1]")] or [b["text"] for b in blocks] == ["menu", "x", "foot"]
    lines = ["1,234"] * 9 + ["words"] + ["5%"] * 3
    rows = spark.createDataFrame([("Figure 2\n" + "\n".join(lines), lines)], "t string, l array<string>")
    assert tuple(rows.select(quality.chart_signal(F.col("t"), F.col("l")).alias("s")).first().s) == ("chart_or_table_candidate", True, 1, 12, 9)


def test_tables_are_blocks(spark):
    page = b"<body><p>before</p><table><caption>cap</caption><tr><th>item</th><th>2024</th></tr><tr><td>sales</td><td><p>1</p><p>2</p></td></tr><tr></tr><tr><td>item<td>2024</tr></table>after<table></table><table><tr><td>open"
    blocks = documents.EXTRACTORS["html"](page)
    assert [(b["block_type"], b["text"]) for b in blocks] == [
        ("paragraph", "before"), ("caption", "cap"), ("paragraph", "item"), ("paragraph", "2024"), ("paragraph", "sales"), ("paragraph", "1"), ("paragraph", "2"), ("paragraph", "item"), ("paragraph", "2024"),
        ("table", "item | 2024\nitem | 2024 => sales | 1 2\nitem | 2024 => item | 2024"), ("paragraph", "after"), ("paragraph", "open"),
    ]
    table = next(b for b in blocks if b["block_type"] == "table")
    assert table["dom_path"] == "body[1]>table[1]" and table["table_rows"][:2] == [["item", "2024"], ["sales", "1 2"]] and table["end_char"] - table["start_char"] == len(table["text"])
    assert all(b.get("table_rows") is None for b in blocks if b is not table)
    wide = b"<table>" + (b"<tr>" + b"<td>" + b"x" * 999 + b"</td>" + b"<td>y</td>" * 79 + b"</tr>") * 300 + b"</table>"
    rows = documents.extracted(spark.createDataFrame([(1, wide)], "k int, c binary"), ["k"], "c", F.lit("html")).where("block_type = 'table'").first().table_rows
    assert (len(rows), len(rows[0]), len(rows[0][0])) == (200, 40, 200)


def test_registries(spark, tmp_path):
    with pytest.raises(LookupError, match="reports_archive"):
        registries.build_adapter(spark, {"type": "none"})
    with pytest.raises(FileNotFoundError):
        registries.ReadOnlyStore(spark, str(tmp_path / "none"), ())
    spark.range(3).write.parquet(str(tmp_path / "blocks.parquet"))
    with pytest.raises(ValueError, match="jobs"):
        registries.ReadOnlyStore(spark, str(tmp_path), ("blocks", "jobs"))
    assert registries.ReadOnlyStore(spark, str(tmp_path), ("blocks",)).blocks.count() == 3
    cache = spark.createDataFrame([], "text_sha string, provider string, vector array<double>")
    with pytest.raises(Exception, match="dimension mismatch"):
        registries.filled_embeddings(cache, spark.createDataFrame([("a",)], "text string"), "mock", 3).collect()


def test_activation_is_compare_and_set(spark):
    heads = spark.createDataFrame([("a", 2, "p1"), ("b", 1, "p1")], "block_id string, revision int, projection_id string")
    wanted = spark.createDataFrame([("a", 2, "p2"), ("a", 2, "p3"), ("b", 0, "p2"), ("c", 0, "p9"), ("d", 1, None)], "block_id string, expected int, projection_id string")
    got = sorted(tuple(r) for r in projections.activated(heads, wanted).fillna("", "projection_id").collect())
    assert got == [("a", "activated", "p2", 3), ("a", "conflict", "p2", 3), ("b", "conflict", "p1", 1), ("c", "activated", "p9", 1), ("d", "conflict", "", 0)]
