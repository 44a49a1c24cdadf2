"""One text of over two million characters beside short ones, through Spark: whole results, and the short ones as without it."""

import random

import pytest
from pyspark.sql import functions as F

from stratafolio.llm import brown_lm, decontamination, language_id, pii, quality_classifier, quality_rules, simhash
from stratafolio.llm.shingles import plain_words

WORDS = 400_000


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    long = prose(WORDS - 6) + " call 212-555-0198 the needle of five"
    return spark.createDataFrame([(1, long, "en"), (2, long, "en"), (3, "x" * 2_000_000, "en"), (4, prose(60), "en"), (5, "deux mots", "fr")], "doc_id long, text string, lang string").repartition(3)


def test_decontamination(spark, docs):
    item = "call 212-555-0198 the needle of five"
    benchmark = spark.createDataFrame([(7, item), (8, "x" * 2_000_000), (9, "not there at all in any text")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.shared) for r in decontamination.leaks(docs, benchmark).collect())
    n = len(plain_words(item.encode())) - 4
    assert got == [(1, 7, n), (2, 7, n), (3, 8, 1)]


def test_simhash(docs):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and len(got) == 5


def test_quality_rules(docs):
    out = {r.doc_id: r for r in quality_rules.judge(docs).select("row.doc_id", "m.n_words", "m.word_chars", "base_failed").collect()}
    assert out[1].n_words == WORDS and out[3].n_words == 1 and out[3].word_chars == 2_000_000 and out[3].base_failed


def test_pii(docs):
    out = {r.doc_id: r for r in pii.pseudonymised(docs, "key").select("row.doc_id", "text", "found").collect()}
    assert out[1].text == out[2].text and "212-555-0198" not in out[1].text and [f.kind for f in out[1].found] == ["phone"] and out[3].text == "x" * 2_000_000


def test_models(spark, docs):
    model = language_id.trained(docs)
    assert {r.doc_id: r.lang_pred for r in language_id.predicted(docs, model).collect()}.keys() == {1, 2, 3, 4, 5}
    quality = quality_classifier.trained(docs, spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality_classifier.scored(docs, quality).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    lm, counts = brown_lm.trained(docs.where("doc_id <> 2").select("text"))
    got = {r.doc_id: r for r in brown_lm.scored(docs, lm, counts).collect()}
    assert got[1].n_tokens == got[1].n_known == WORDS + 1 and got[1].score == got[2].score and got[3].n_tokens == 2 and got[3].train_tokens == WORDS + 1 + 2 + 61 + 3
