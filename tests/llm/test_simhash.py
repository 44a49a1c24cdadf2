import random

import numpy as np
import pytest
import xxhash

from stratafolio.llm import simhash


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(values))]


def texts():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(120)) for _ in range(25)]
    near = [t.replace(t.split()[60], f"x{k}", 1) for t in base for k in range(3)]
    return [*base, *near, base[0], base[0].upper(), None, "", " \n", "one", "one two", "ONE two"]


def test_against_brute_force(spark):
    every = texts()
    rows = [(k, t, 0, "c") for k, t in enumerate(every)] + [(3, every[3], 0, "c"), (None, every[4], 0, "c"), (None, "lonely words that nobody else has", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    values = [plain_fingerprint(t) for t in every]
    component = plain_components(values, 4)
    least = {}
    for k, c in enumerate(component):
        least[c] = min(k, least.get(c, k))
    for k in range(len(every)):
        assert by_id[k].fp % 2**64 == values[k]
        assert by_id[k].component_id == least[component[k]]
    assert {r.component_id for r in got if r.doc_id is None} == {least[component[4]], None}


@pytest.mark.parametrize("groups", [2, 3, 4, 5])
@pytest.mark.parametrize("block", [2048, 16])
def test_every_plan_finds_every_link(spark, groups, block, monkeypatch):
    rng = np.random.default_rng(groups)
    centres = rng.integers(0, 2**64, 12, np.uint64)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            values.add(int(c) ^ sum(1 << int(f) for f in flips))
    values = sorted(values)
    distinct = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    n, ones, correlation = simhash.bit_statistics(distinct)
    assert n == len(values)
    parts = simhash.group_bits(correlation, groups)
    _, thresholds = simhash.allot(n, ones, parts, 4)
    assert sum(thresholds) == 4 - groups + 1 and sorted(b for p in parts for b in p) == list(range(64))
    monkeypatch.setattr(simhash, "plan", lambda *_: (n, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", 8)
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(distinct).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    want = plain_components(values, 4)
    assert len({(want[k], find(v)) for k, v in enumerate(values)}) == len(set(want)) == len({find(v) for v in values})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chain_is_one_component(spark):
    from stratafolio.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[501] == 500
