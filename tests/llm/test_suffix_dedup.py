import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stratafolio.llm import suffix_dedup


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [24_000_000, 15_000])
def test_against_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(n))
    passage, texts = prose(60), []
    for k in range(70):
        texts.append(prose(rng.randint(0, 40)) + passage[: rng.randint(50, len(passage))] + prose(rng.randint(0, 40)))
    texts += ["a" * 900, "ab" * 300, None, "", "x" * 63, "y" * 64, texts[0], texts[0], texts[1] + texts[1]]
    docs = spark.createDataFrame([(k, t, 0, 1) for k, t in enumerate(texts)] + [(None, texts[2], 0, 1)], "doc_id long, text string, key int, runs int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs, 64, 16).collect()}
    want = brute([(t or "").encode() for t in [*texts, texts[2]]], 64)
    for k in range(len(texts)):
        assert got[k] == want[k], k
    assert got[None] == want[-1]


def test_long_texts_are_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    rng = random.Random(4)
    a = "".join(rng.choices("xyz ", k=500))
    texts = [a + "".join(rng.choices("xyz ", k=100)), "q" + a[100:400], "r" * 30]
    got = sorted(tuple(r) for r in suffix_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 64, 16).collect())
    assert [g[1:] for g in got] == brute([t.encode() for t in texts], 64)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, (500, 5)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words)
    assert [words[k].tolist() for k in order] == sorted(words.tolist())


def test_sliding_minimum():
    a = np.random.default_rng(2).integers(0, 99, 300).astype(np.uint64)
    for w in (1, 7, 300):
        assert suffix_dedup.sliding_minimum(a, w).tolist() == [int(a[k : k + w].min()) for k in range(300 - w + 1)]


def test_empty_table(spark):
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
