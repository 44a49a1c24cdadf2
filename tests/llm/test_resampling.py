import hashlib
import math
import random
import re
import zlib
from collections import Counter

from stratafolio.llm import resampling
from stratafolio.llm.resampling import histogram, packed, resampled, unpacked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += plain_features(text)[1]
    for text in target:
        t += plain_features(text)[1]
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)]
    out = []
    for k, text in docs:
        n, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append([k, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((r[:5] for r in out), key=repr)


def run(spark, docs, target, **more):
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in resampled(a, b, **more).collect()), key=repr)


def test_given_tables_against_plain_python(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert run(spark, docs, target) == plain(docs, target)


def test_copies_nulls_ties_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = ["The", "été", "a1", "x-y", "中文", "b_c"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(1000 + k, "Same text " * 15) for k in range(120)] + [(None, "null id " * 12), (3, "repeated " * 25), (3, "repeated " * 25), (7, None), (8, ""), (9, " .\n"), (10, "long ones " * 200_000)]
    assert run(spark, docs, ["the été", None, "same text"], percent=30) == plain(docs, ["the été", None, "same text"], 30)


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], ["a b"]) == []
    docs = [(k, "some words of a text " * 5) for k in range(40)]
    assert run(spark, docs, []) == plain(docs, [])
    clash = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id int, text string, sha int, copies int, score int")
    assert [r.n_features for r in resampled(clash, clash).collect()] == [3]


def test_slices_carry_words_over(monkeypatch):
    text = "One two, three fouré five six SEVEN " * 40
    whole = histogram(text.encode())
    monkeypatch.setattr(resampling, "SLICE", 7)
    n, counts = histogram(text.encode())
    assert n == whole[0] == plain_features(text)[0]
    assert (counts == whole[1]).all() and {b: c for b, c in enumerate(counts) if c} == plain_features(text)[1]
    at, c = unpacked(*packed(counts))
    assert (counts[at] == c).all() and c.sum() == counts.sum()
