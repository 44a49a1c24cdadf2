import random

import numpy as np
import pytest

from stratafolio.llm import suffix_dedup

from .test_suffix_dedup import brute


@pytest.mark.parametrize("group", [3, 40])
def test_a_seed_with_too_many_contexts_is_cut_into_narrower_runs(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefg hé", k=300))
    texts = []
    for k in range(120):
        at = rng.randrange(len(base) - 5)
        texts.append(base[:at] + f"#{k}#" + base[at + rng.randint(0, 5) :])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs, 64, 16).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 64)


def test_kept_text(spark):
    a = "".join(random.Random(1).choices("abcdef", k=500))
    rows = [(1, "start " + a + " end"), (2, "other " + a), (3, a[:399]), (4, None), (5, "é" * 10)]
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert [got[k].text for k in range(1, 6)] == ["start  end"[:5] + " end", "other", a[:399], "", "é" * 10] and got[4].n_bytes == 0


def test_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 16)).astype(np.uint8)
    place, shared = suffix_dedup.common_prefixes(rows)
    ordered = rows[np.argsort(place)]
    assert ordered.tolist() == sorted(rows.tolist())
    for k in range(1, 300):
        assert shared[k] == next((i for i in range(16) if ordered[k, i] != ordered[k - 1, i]), 16)
