import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratafolio.llm.packing import WordIds, best_fit_plan, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 37, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    left, placed = {}, dict.fromkeys(counts, 0)
    for length, rank, n, window, offset in best_fit_plan(counts, capacity):
        assert rank == placed[length]
        placed[length] += n
        for w in range(window, window + n):
            assert left.get(w, capacity) == capacity - offset
            left[w] = capacity - offset - length
    assert placed == counts
    assert sorted(left.values()) == best_fit(lengths, capacity)
    assert sorted(left) == list(range(len(left)))


@pytest.mark.parametrize("text", ["", "a  b\nc", "I'm don't", "x\x1cy", "é é ́z", "<|endoftext|> a<|startoftext|>b", "１２ 한글 नमस्ते", "ΑΣ ΣΑΣ"])
def test_words_give_the_ids_of_the_text(text):
    words = WordIds.at(PATH)
    assert list(words.of([text])) == [words.encode(text)]


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("seed", range(8))
def test_runs_of_words_give_the_ids_of_each(seed, marked):
    """Words encoded between marks, words that hold the mark, words without ids, and a vocabulary without a mark."""
    rng, words = random.Random(seed), WordIds(PATH)
    signs = ["a", "B", "é", "\u0301", "\ufeff", "한", "ा", "7", "-", "'s", "☃", "<|endoftext|>", "\u200b", "İ"] + (["\x01"] if seed % 2 else [])
    many = ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(700)]
    if not marked:
        words.mark = None
    assert list(words.each(many)) == [words.encode(w) for w in many]
    assert list(words.of([" ".join(many), "", "\x01"])) == [words.encode(t) for t in (" ".join(many), "", "\x01")]


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(1)
    texts = [None, "", "word", "word"] + [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 400))) for _ in range(80)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(0, None, "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, salt int")
    got = pack(docs, PATH, capacity=64).collect()
    tokenizer, by_doc, windows = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        windows[p.sequence_id].append((p.offset, p.length))
    for k, text in enumerate(texts[1:], 1):
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 1
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(windows) == list(range(len(windows)))
    tails = [p.length for p in got]
    assert len(windows) == len(best_fit(tails, 64))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
