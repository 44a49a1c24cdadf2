import pytest
from pyspark.sql import functions as F

from stratafolio.functions import dates, metadata, numbers, quality, text


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_tokens(spark):
    got = each(spark, ["Hello-World v1.2 a", "财报 x", "中", "", "中文字abc"], text.tokens)
    assert got == [["hello-world", "v1.2", "a"], ["x", "财", "报", "财报"], ["中"], [], ["abc", "中", "文", "字", "中文", "文字"]]


def test_normalized(spark):
    assert each(spark, ["ＡＢ 財報", "", None], text.normalized) == ["AB 财报", "", None]


def test_snippet(spark):
    rows = spark.createDataFrame([("x" * 100 + "needle" + "y" * 100,), ("nothing",)], "t string")
    shown, spans = text.snippet(F.col("t"), F.array(F.lit("Needle"), F.lit("absent")))
    got = rows.select(shown.alias("s"), spans.alias("p")).collect()
    assert len(got[0].s) == 80 and "needle" in got[0].s and [(p.start, p.end) for p in got[0].p] == [(100, 106)]
    assert got[1].s == "nothing" and got[1].p == []


@pytest.mark.parametrize(
    "value, tags",
    [("a" * 98 + "\x01\x02", []), ("a" * 97 + "\x01\x02\x03", ["control_characters"]), ("a" * 500 + "\x01\x02\x03\x04", ["control_characters"]), ("a" * 97 + "\x80\x81\x82", ["c1_or_del_characters"]),
     ("éééééé a éééééé a éééééé", ["cid_style_glyph_runs"]), ("é" * 17, []), ("é" * 18, ["cid_style_glyph_runs"]), ("plain\n\ttext", [])],
)
def test_damage(spark, value, tags):
    assert each(spark, [value], quality.damage_tags) == [tags]


def test_numbers(spark):
    cases = {
        "1,234.56": (1234.56, []), "(1,234)": (-1234.0, []), "-12.3%": (-12.3, []), "$1,234": (1234.0, []), "1.234,56": (1234.56, []), "1,5": (None, ["ambiguous_decimal_comma"]),
        "1,23,456": (None, ["malformed_grouping"]), "1,23.4": (None, ["malformed_grouping"]), "n/a": (None, ["empty"]), "": (None, ["empty"]), "abc": (None, ["not_a_plain_number"]), "–5": (None, ["not_a_plain_number"]), "(123": (None, ["unparseable"]), "1.2.3": (None, ["unparseable"]), "12 345": (12345.0, []),
    }
    got = each(spark, list(cases), numbers.number_of)
    assert [(g.value, g.issues) for g in got] == list(cases.values())
    assert got[1].negative_style == "parentheses" and got[2].is_percent and got[2].negative_style == "minus" and got[3].currency == "$"


def test_byte_ranges(spark):
    got = each(spark, [None, "bytes=0-9", "bytes=5-", "bytes=-3", "bytes=20-", "bytes=9-3", "bytes=-", "bytes=1-2,3-4", "x"], lambda h: metadata.byte_range(h, F.lit(10).cast("long")))
    assert [(g.kind, g.start, g.end) for g in got] == [("full", None, None), ("range", 0, 9), ("range", 5, 9), ("range", 7, 9)] + [("invalid", None, None)] * 5


def test_flags(spark):
    row = spark.createDataFrame([("2021-12-31", "2022-12-01", "2023財政年度中期報告", "", "Interim Report"), ("2022-09-30", "2022-12-01", "2023財政年度中期報告", "S", "x"), ("2023Q1", None, "", "S", "annual")], "p string, d string, t string, s string, k string")
    got = [r.f for r in row.select(metadata.flags_of(*map(F.col, "pdtsk")).alias("f")).collect()]
    assert got == [["period_title_mismatch", "symbol_missing"], [], ["period_invalid"]]


def test_instants(spark):
    got = each(spark, ["2024-01-01T00:00:00Z", "2024-01-01T08:00:00+08:00", "2024-01-01", "soon", None], lambda v: dates.utc_text(dates.instant_of(v)))
    assert got == ["2024-01-01T00:00:00Z"] * 3 + [None] * 2


def test_cursor_and_statuses(spark):
    from stratafolio.operators.retrieval import decode_cursor, encode_cursor

    cursor = encode_cursor(digest="a", offset=5)
    assert decode_cursor(cursor, digest="a")["offset"] == 5
    for bad in ("!!", cursor):
        with pytest.raises(ValueError):
            decode_cursor(bad, digest="b")
    assert each(spark, ["ready", "odd", "failed"], lambda v: quality.worst_status(v, F.lit("ready"))) == ["ready", "review", "failed"]
