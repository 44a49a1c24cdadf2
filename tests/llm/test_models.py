import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stratafolio.llm import brown_lm, language_id, quality_classifier
from stratafolio.llm.queries import op2_language_id, op7_lm_scoring, op8_quality_classifier


def docs_of(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_language_held_out_accuracy(spark, sf):
    docs = docs_of(spark, sf)
    got = op2_language_id(spark, sf).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9


def test_language_edges(spark):
    rows = [(k, t, lang, 1) for k, (t, lang) in enumerate([("the cat sat", "en"), ("der hund lief", "de"), (None, "en"), ("12 34", "en"), ("le chat", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language_id.predicted(docs, language_id.trained(docs)).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3))
    nothing = language_id.trained(docs.limit(0))
    assert {r.lang_pred for r in language_id.predicted(docs, nothing).collect()} == {"und"}
    assert language_id.predicted(docs.limit(0), nothing).collect() == []


def test_ngrams_of_blocks_are_those_of_the_text(monkeypatch):
    text = "".join(random.Random(3).choices("abcé ", k=100))
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "CHARS", 17)
    assert (language_id.counts(text) == whole).all() and whole.sum() == 100 + 99 + 98


def test_quality_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op8_quality_classifier(spark, sf).collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.85


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "text", 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_classifier.scored(docs, quality_classifier.trained(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 4
    assert quality_classifier.scored(docs.limit(0), quality_classifier.trained(docs, none)).collect() == []


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9


def plain_base(docs):
    seen, tokens = Counter(), {}
    for k, text in docs.items():
        tokens[k] = [*(text or "").encode().lower().split(), None]
        if zlib.crc32(str(k).encode()) % 7 != 2:
            seen.update(tokens[k])
    n, v = sum(seen.values()), len(seen)
    return {k: (len(t), sum(seen[w] > 0 for w in t), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)) for k, t in tokens.items()}


@pytest.mark.parametrize("head", [brown_lm.HEAD, 50])
def test_lm_base_score(spark, sf, head, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    want = plain_base({k: r.text for k, r in docs_of(spark, sf).items()})
    got = op7_lm_scoring(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(1)
    texts = spark.createDataFrame([(" ".join(rng.choices(["a", "b", "cc", "dd", "e"], k=30)),) for _ in range(20)], "text string")
    model, counts = brown_lm.trained(texts)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    every = {bytes(r.word): r.c for r in counts.collect()}
    for k in range(brown_lm.CLASSES):
        own = [c for w, c in every.items() if model.class_of_unit[model.vocabulary.unit(w)] == k]
        if own:
            assert sum((c + brown_lm.ADD_WORD) / 10 ** model.under[k] for c in own) <= 1 + 1e-9


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(3)
    b = np.zeros((21, 21))
    for u in range(20):
        for v in range(20):
            if u % 2 != v % 2:
                b[u, v] = rng.integers(50, 90)
    b[20, :20] = b[:20, 20] = 1
    of = brown_lm.exchange(b, classes=3, sweeps=20)
    assert of[20] == 0 and len({of[k] for k in range(0, 20, 2)}) == 1 and len({of[k] for k in range(1, 20, 2)}) == 1 and of[0] != of[1]


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 0)], "doc_id long, text string, row int")
    model, counts = brown_lm.trained(docs.limit(0).select("text"))
    got = brown_lm.scored(docs, model, counts).collect()
    assert len(got) == 3 and {r.base_score for r in got} == {0.0} and {r.n_known for r in got} == {0}
    assert brown_lm.scored(docs.limit(0), model, counts).collect() == []
