import random

import numpy as np
import pytest

import corpus_pipeline
from stratafolio.llm import near_copies

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"x{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))


def survivors(texts):
    """Ids that stay, by comparing every pair."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {k for k in range(len(sets)) if find(k) == k}


def stay(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], KIND).repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out.collect())


def test_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(8)
    texts = ["", None, " \n", "one two", "ONE  two", "one two three"]
    for _ in range(12):
        base = words_of(rng, rng.randint(50, 300))
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05) for _ in range(3)]
    want = survivors(texts)
    assert 20 < len(want) < len(texts) - 60
    assert [k for _, k, _ in stay(spark, enumerate(texts))] == sorted(want)


def test_given_documents(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    got = [k for _, k, _ in stay(spark, [tuple(r) for r in rows])]
    assert got == sorted(survivors([r.text for r in rows])) and 177 not in got  # 1 and 177: similarity 0.83, 9 bits apart


@pytest.mark.parametrize("length", [200, 1000])
def test_threshold(length):
    a = np.arange(length, dtype=np.uint64)
    at, below = a + np.uint64(length // 9), a + np.uint64(length // 9 + 1)  # 8 / 10 needs a shift of a ninth at most
    assert near_copies.spanning([a, at], 0.8) == [(0, 1)] and near_copies.spanning([a, below], 0.8) == []


def test_one_task_does_not_hold_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(2)
    base = words_of(rng, 150)
    texts = [" ".join([*base[:k], f"y{k}", *base[k + 1 :]]) for k in range(150)]
    assert [k for _, k, _ in stay(spark, enumerate(texts))] == [0]
