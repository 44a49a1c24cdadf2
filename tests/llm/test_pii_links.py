import re

from pyspark.sql import functions as F

from stratafolio.llm import pii

from .test_pii import KEY, run


def pseudonyms(spark, values):
    got = run(spark, [f"see {v} there" for v in values])
    assert [[f.value for f in r.found] for r in got] == [[v] for v in values]
    return [r.found[0].pseudonym for r in got]


def test_one_number_in_many_forms(spark):
    forms = ["212-555-0198", "(212) 555-0198", "212.555.0198", "2125550198", "+1 212 555 0198", "+1 (212) 555-0198"]
    got = pseudonyms(spark, forms)
    digits = {re.sub(r"[^0-9]", "", p)[-10:] for p in got}
    assert len(digits) == 1 and re.fullmatch("[2-9]..[2-9]......", digits.pop())
    for form, p in zip(forms, got):
        assert re.sub("[0-9]", "0", form) == re.sub("[0-9]", "0", p)


def test_case_and_writing_of_the_rest(spark):
    one, two = pseudonyms(spark, ["Bob.Lee@x.com", "bob.lee@x.com"])
    assert one.lower() == two and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@x\.com", one)
    iso, day, month = pseudonyms(spark, ["1999-12-31", "31/12/1999", "12/31/1999"])
    y, m, d = iso.split("-")
    assert day == f"{d}/{m}/{y}" and month == f"{m}/{d}/{y}"
    short, long = pseudonyms(spark, ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1"])
    assert short == long and re.fullmatch("([0-9a-f]{4}:){7}[0-9a-f]{4}", short)
    a, b = pseudonyms(spark, ["4111 1111 1111 1111", "4111-1111-1111-1111"])
    assert a.replace(" ", "-") == b


def test_what_is_no_value_stays(spark):
    texts = ["std::cout a::b 12:30:45 1::2::345", "1234567890 0125550198", "13/13/1999", "1:2:3:4:5:6:7:8:9"]
    assert [(r.text, r.found) for r in run(spark, texts)] == [(t, []) for t in texts]


def test_small_formats_have_no_fixed_point(spark):
    every = spark.range(26).select(F.chr(F.col("id") + 97).alias("v"))
    for key in map(str, range(6)):
        got = every.select("v", pii.replaced_text(F.col("v"), key, "t").alias("p"), pii.permuted_text(F.col("v"), key, "t").alias("q")).collect()
        assert len({r.q for r in got}) == 26 and all(r.v != r.p and r.p == (r.q if r.q != r.v else chr((ord(r.q) - 96) % 26 + 97)) for r in got)
    pairs = spark.range(21).select("id", pii.replaced_pair(F.floor(F.col("id") / 7), F.col("id") % 7, 3, 7, KEY, "t").alias("p")).collect()
    assert all((r.id // 7, r.id % 7) != (r.p.x, r.p.y) for r in pairs)


def test_key_comes_from_the_setting(spark):
    docs = spark.createDataFrame([(1, "mail bob@x.com")], "doc_id long, text string")
    text = lambda: pii.pseudonymised(docs).first().text
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        assert text() == text() == pii.pseudonymised(docs, KEY).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert len({pii.key_of(spark) for _ in range(3)}) == 3
