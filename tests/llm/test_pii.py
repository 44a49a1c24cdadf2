import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratafolio.llm import pii

KEY = "k"
CLASSES = (pii.DIGITS, pii.LOWER, pii.UPPER)


def plain_text(value, kind, classes=CLASSES):
    """The Feistel permutation again, in plain Python."""
    cut = len(value) // 2
    halves = [value[:cut], value[cut:]]
    for turn in range(pii.ROUNDS):
        own, other = halves[turn % 2], halves[1 - turn % 2]
        stream = hashlib.sha512("|".join((KEY, kind, str(turn), other)).encode()).hexdigest()
        out = ""
        for j, c in enumerate(own):
            byte = int(stream[(j % 64) * 2 : (j % 64) * 2 + 2], 16)
            for chars in classes:
                if c in chars:
                    out += chars[(chars.index(c) + byte) % len(chars)]
                    break
            else:
                out += c
        halves[turn % 2] = out
    return "".join(halves)


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def run(spark, texts):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, t int")
    return sorted(pii.pseudonymised(docs, KEY).select("row.doc_id", "text", "found", F.col("row.found").alias("kept")).collect())


def test_formats(spark):
    texts = [
        "mail bob.7@mail.example.com. or bob.7@mail.example.com!",
        "cards 4111111111111111 4111 1111 1111 1111 and 1234567812345678",
        "phone +1 (017) 555-7713%%% and +33 6 12 34 56 78",
        "ip 10.0.0.1, not 999.1.1.1 nor 1.2.3.4.5",
        "iban GB82 WEST 1234 5698 7654 32 not GB83 WEST 1234 5698 7654 32",
        "dates 1999-02-28 31/12/2024 but 1999-02-30",
        "ssn 123-45-6789 not 000-45-6789",
        'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"',
        None,
        "",
        "nothing here, version 2.0 of 1234",
        "x " * 5000 + "4111111111111111",
    ]
    got = run(spark, texts)
    assert [len(r.found) for r in got] == [2, 2, 2, 1, 1, 2, 1, 1, 0, 0, 0, 1]
    pseudonyms = {f.value: f.pseudonym for r in got for f in r.found}
    assert pseudonyms["bob.7@mail.example.com"] == plain_text("bob.7", "email") + "@mail.example.com"
    card = plain_text("411111111111111", "card")
    assert pseudonyms["4111111111111111"][:15] == card and luhn(pseudonyms["4111111111111111"])
    assert pseudonyms["4111 1111 1111 1111"].replace(" ", "") == pseudonyms["4111111111111111"]
    assert pseudonyms["+1 (017) 555-7713"] == "+1 " + plain_text("(017) 555-7713", "phone")
    secret = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert pseudonyms[secret] == plain_text(secret, "secret", (pii.HEX_LOWER,))
    assert all(int(o) <= 255 for o in pseudonyms["10.0.0.1"].split("."))
    iban = pseudonyms["GB82 WEST 1234 5698 7654 32"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}", pseudonyms["1999-02-28"]) and re.fullmatch(r"\d{2}/\d{2}/\d{4}", pseudonyms["31/12/2024"])
    for r, text in zip(got, texts):
        want = text
        for f in r.found:
            want = want.replace(f.value, f.pseudonym)
        assert r.text == want
        assert r.kept == "x"


def test_dates_and_numbers_are_permuted_one_to_one(spark):
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    out = days.select(pii.pseudonym(F.col("v"), F.lit("date"), KEY).alias("p"))
    assert out.distinct().count() == 3000 and out.where(F.col("p").try_cast("date").isNull()).count() == 0
    pairs = spark.range(21).select(F.col("id"), pii.permuted_pair(F.floor(F.col("id") / 7), F.col("id") % 7, 3, 7, KEY, "t").alias("p"))
    assert len({(r.p.x, r.p.y) for r in pairs.collect()}) == 21


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("address", ["_@x.com", "-@y.org", "...@x.com", "__@x.com"])
def test_addresses_with_nothing_to_permute_stay(spark, address):
    out = pii.pseudonymised(spark.createDataFrame([(1, f"write to {address} today")], "doc_id long, text string"), "k").first()
    assert out.text == f"write to {address} today" and out.found == []


def test_no_plan_shows_the_key(spark):
    secret = "a-key-that-nobody-may-see"
    docs = spark.createDataFrame([(1, "mail bob@x.com on 1999-02-28, 10.0.0.1"), (2, None)], "doc_id long, text string")
    out = pii.pseudonymised(docs, secret)
    out.collect()
    assert secret not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
    assert [len(r.found) for r in out.orderBy("row.doc_id").collect()] == [3, 0]
