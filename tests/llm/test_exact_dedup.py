import hashlib
import random
import re

import numpy as np
import pytest

from stratafolio.llm import exact_dedup
from stratafolio.llm.exact_dedup import CountingQuotientFilter, deduplicated


def plain(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and the number of rows kept of each text."""
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (k, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(k)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return sorted(((k, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (k, _), t in zip(rows, norm)), key=repr), groups


def compare(spark, rows):
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_against_plain_python(spark):
    rng = random.Random(3)
    words = ["a", "b", "ä", "c d"]
    rows = [(k, rng.choice([" ", "\n", " \t", "\x0b"]).join(rng.choices(words, k=rng.randint(0, 4)))) for k in range(300)]
    rows += [(1000 + k, "the same\ttext") for k in range(200)] + [(5000, "x" * 300_000 + " y"), (5001, "x" * 300_000 + "\n\ny"), (5002, "x" * 300_000 + "y")]
    rng.shuffle(rows)
    compare(spark, rows)


def test_nulls_repeats_and_blanks(spark):
    compare(spark, [(None, None), (None, ""), (3, None), (4, " "), (5, "\n\t"), (7, "a"), (7, "a"), (7, "b"), (None, "c"), (None, "c"), (9, " "), (8, " ")])


def test_empty_table_and_clashing_names(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    more = spark.createDataFrame([(1, "a", 5, "x", 2), (2, "a", 6, "y", 3)], "doc_id int, text string, norm int, sha string, size int")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in deduplicated(more).collect()) == [(1, 1, True), (2, 1, False)]


def test_shared_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    """With filters of one bit and routes of none, all rows are compared; the result is the same."""
    monkeypatch.setattr(exact_dedup, "ROUTE_BITS", 0)
    compare(spark, [(k, f"t{k % 7}") for k in range(40)])


@pytest.mark.parametrize("seed", range(20))
def test_filters_merge_losslessly(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 2 ** (33 if seed % 2 else 48), rng.integers(0, 60), np.uint64) // np.uint64(1 << 28) for _ in range(4)]
    whole, merged = np.concatenate(parts), None
    for p in parts:
        own = CountingQuotientFilter.of(*np.unique(p, return_counts=True))
        own = CountingQuotientFilter.of_row(*own.row())
        merged = own if merged is None else merged.merged(own)
    fps, counts = np.unique(whole, return_counts=True)
    assert (merged.fingerprints() == fps).all() and (merged.counts == counts).all()
    assert (merged.repeated() == fps[counts > 1]).all()
    assert (np.diff(merged.quotients.astype(int)) > 0).all() and merged.runs.sum() == len(fps)


def test_a_task_may_send_several_filters(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "HELD", 5)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 40, np.uint64)[rng.integers(0, 40, 200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(fps[k : k + 9].view(np.int64))], names=["fp"]) for k in range(0, 200, 9)]
    rows = sorted((r for b in exact_dedup._filters(iter(batches), 7) for r in b.to_pylist()), key=lambda r: r["block"])
    found = [r for b in exact_dedup._merged(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.column("low").to_pylist()]
    low, counts = np.unique(fps & exact_dedup._LOW, return_counts=True)
    assert sorted(found) == low[counts > 1].tolist()
