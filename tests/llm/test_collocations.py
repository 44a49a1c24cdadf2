import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratafolio.llm import collocations
from stratafolio.llm.collocations import CountMin, Grams, mined, slices, survivors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least=30, top=2000, share=80):
    out = []
    f, n = plain_counts(rows)
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in phrases.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        found = []
        for p, a in phrases.items():
            if p in most and 100 * most[p] >= share * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in mined(docs, **more).collect())


def test_given_tables_against_plain_python(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == plain(rows)


def test_small_slices_nulls_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    words = ["New", "York", "the", "été", "of\t", "\x00", "a.", "b,", "c\n", "中文"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 90))), rng.choice(["en", None, "und", "de"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t\n.", "fr"), ("repeat " * 300_000, "en"), ("new york of the new york", "en")]
    rows += [("one two three four five", "fr")] * 40
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, least=5, top=7, share=50) == plain(rows, 5, 7, 50)


@pytest.mark.parametrize("size", [1, 5, 40, 1000])
def test_slices_count_each_occurrence_once(monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE", size)
    texts = ["The cat, the cat sat on the  cat", "", "a b c d e f g the cat sat on", "x" * 50 + " y\tz", "end."]
    bits = np.full((collocations.DEPTH, 8192), 255, np.uint8)
    got, n, tail = Counter(), 0, []
    for data, more in slices(t.encode() for t in texts):
        grams = Grams(data, tail if more else [])
        tail = grams.tail
        n += len(grams)
        for _, names, counts in survivors(grams, "en", bits):
            for name, c in zip(names, counts.tolist()):
                got[tuple(name.decode().split(" "))] += c
    want, total = plain_counts([(t, "en") for t in texts])
    assert +got == want["en"] and n == total["en"]


def test_sketches_never_count_too_low():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400, np.uint64)[rng.zipf(1.3, 5000) % 400]
    parts, top = np.array_split(h, 7), 30
    total = np.zeros((collocations.DEPTH, 64), np.int64)
    for p in parts:
        sketch = CountMin(64, top)
        for q in np.array_split(p, 3):
            sketch.add(q)
        total += sketch.rows
    bits = np.packbits(total >= top, axis=1, bitorder="little")
    value, count = np.unique(h, return_counts=True)
    assert collocations.surviving(bits, value[count >= top]).all()


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    more = spark.createDataFrame([("a b " * 40, "en", 1, 2)], "text string, lang string, f int, phrase int")
    assert [(r.phrase, r.n) for r in mined(more).orderBy("rank").collect()][0][1] == 80


def test_products_beyond_64_bits(spark):
    big = 2**61
    rows = [("en", 2, "a b", big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 0, "", 2**62)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, n_words int, phrase string, f long")).collect()
    assert [r.score for r in got] == [2_000_000 * big // (2 * big + 1)]
