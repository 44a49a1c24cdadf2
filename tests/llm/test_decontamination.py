import random

import pytest

from stratafolio.llm import decontamination
from stratafolio.llm.shingles import Powers, hashed, plain_words


def shingles(text):
    words = plain_words((text or "").encode())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block_bytes", [16_000_000, 800])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    items = [(k, prose(rng.randint(3, 40))) for k in range(25)] + [(25, None), (26, ""), (27, "two words"), (3, "twice here is one two three four")]
    docs = []
    for k in range(60):
        words = items[k % 25][1].split()
        keep = words[: max(1, int(len(words) * rng.choice([0.5, 0.85, 1.0])))]
        docs.append((k, prose(rng.randint(0, 300)) + " " + " ".join(keep).upper().replace(" ", ", ") + ". " + prose(rng.randint(0, 50)), 0))
    docs += [(100, None, 0), (101, "", 0), (102, "two WORDS!", 0), (103, items[5][1], 0), (103, items[5][1], 0), (None, items[6][1], 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = frame.select("doc_id", decontamination.leaks_of(frame.text, benchmark, block_bytes=block_bytes).alias("h")).collect()
    got = sorted((str(r.doc_id), h.item_id, h.item_shingles, h.shared) for r in hits for h in r.h)
    want = []
    for doc_id, text, _ in docs:
        have = shingles(text)
        for item_id, item in items:
            q = shingles(item)
            if q and 5 * len(q & have) >= 4 * len(q):
                want.append((str(doc_id), item_id, len(q), len(q & have)))
    assert got == sorted(want)


def test_hashes_cross_blocks(monkeypatch):
    monkeypatch.setattr("stratafolio.llm.shingles.WORDS", 7)
    words = [b"w%d" % (k % 11) for k in range(40)]
    got = [joined[a:b] for joined, s, e, _ in hashed(words, 5, Powers()) for a, b in zip(s, e)]
    assert got == [b" ".join(words[k : k + 5]) for k in range(36)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text of five words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, none).collect() == []
    assert decontamination.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []
