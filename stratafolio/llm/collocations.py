"""Phrase collocations: word n-grams that are frequent, bound together, and not mere parts of longer ones.

A first pass builds a count-min sketch of all n-grams in each task; merged, it never counts an n-gram too low, so what it puts under the
threshold is surely rare. A second pass counts the survivors exactly, as words: an n-gram survives if the sketch lets it and the
two n-grams one word shorter inside it pass. Phrases are then scored by their loosest cut and dropped where a longer one has most of their occurrences.

Words are what spaces and tabs separate inside pieces; pieces end at `.,;:!?` and at line ends; A-Z are lowered. Everything is counted per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, parts, written

LONGEST = 4
#: Bytes of text that are counted at once.
SLICE = 1 << 22
#: Rows of hashes of a sketch, bytes of text a cell (then a cell has about a dozen n-grams), and the bounds of the cells of a row. Beyond the upper
#: one (about 5 GB of text) sketches let more n-grams through to the exact count, which stays exact.
DEPTH, BYTES_A_CELL = 2, 32
CELLS = (1 << 16, 1 << 27)
#: Cells that go as one row from task to task.
STRIPE = 1 << 16
#: Bytes of text that one task counts, about: so many input partitions are read by one task, which sends each cell and each survivor about once.
COUNTED = 1 << 28
#: Different survivors of a task that are held before their counts go out.
HELD = 700_000
UND = "und"

_MARK = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(10 if b in _MARK else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(rb"\n|[^ \n]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def slices(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The cleaned texts in slices of about SLICE bytes, with whether the slice goes on where the one before ended; words are never cut."""
    held, size = [], 0
    for text in texts:
        if size and size + len(text) > SLICE:
            yield b"\n".join(held), False
            held, size = [], 0
        if len(text) <= SLICE:
            held.append(text.translate(_CLEAN))
            size += len(text) + 1
            continue
        at, more = 0, False
        while at < len(text):
            end = at + SLICE
            found = re.compile(rb"[ \t" + re.escape(_MARK) + rb"]").search(text, end)
            end = found.start() if found else len(text)
            yield text[at:end].translate(_CLEAN), more
            at, more = end, True
    if held:
        yield b"\n".join(held), False


class Grams:
    """The n-grams of a slice. ids: the number of each word in `words`, -1 at a mark; run: words since the last mark; fresh: where the slice's own words begin."""

    def __init__(self, data: bytes, carried: list[bytes]):
        tokens = carried + _TOKEN.findall(data)
        known = {b"\n": -1}
        self.ids = np.fromiter((known.setdefault(t, len(known) - 1) for t in tokens), np.int64, len(tokens))
        self.words, self.fresh = list(known)[1:], len(carried)
        place = np.arange(len(tokens))
        marks = np.maximum.accumulate(np.where(self.ids < 0, place, -1)) if len(tokens) else place
        self.run = place - marks
        tail = tokens[-(LONGEST - 1) :]
        self.tail = tail[len(tail) - tail[::-1].index(b"\n") :] if b"\n" in tail else tail

    def __len__(self) -> int:
        """Words of the slice itself."""
        return int((self.ids[self.fresh :] >= 0).sum())

    def ends(self, n: int) -> np.ndarray:
        """Where n-grams of n words end that do not end in carried words."""
        at = np.flatnonzero(self.run >= n)
        return at[at >= self.fresh]

    def hashes(self, lang: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n from 1, the ends of the n-grams and a hash of language and words."""
        from xxhash import xxh3_64_intdigest

        own = np.array([xxh3_64_intdigest(w) for w in self.words] or [0], np.uint64)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        h = own ^ np.uint64(xxh3_64_intdigest(lang.encode()))
        for n in range(1, LONGEST + 1):
            if n > 1:  # the words before, and the last one
                h = np.concatenate((h[:1], (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX[0] + own[1:])) if len(h) else h
            yield self.ends(n), h


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row of a sketch with `width` (a power of two) cells a row."""
    out = []
    for row in range(DEPTH):
        x = (h ^ (h >> np.uint64(31))) * _MIX[row + 1]
        out.append(((x ^ (x >> np.uint64(32))) & np.uint64(width - 1)).astype(np.uint32))
    return out


class CountMin:
    """A count-min sketch that stops counting at `top`: sums of such sketches still reach `top` wherever the true count does."""

    def __init__(self, width: int, top: int):
        self.width, self.top = width, top
        self.rows = np.zeros((DEPTH, width), np.min_scalar_type(2 * top))

    def add(self, h: np.ndarray) -> None:
        for row, at in zip(self.rows, cells_of(h, self.width)):
            at, n = np.unique(at, return_counts=True)
            row[at] = np.minimum(row[at] + np.minimum(n, self.top).astype(row.dtype), self.top)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The texts (binary) of a batch for each of its languages."""
    import pyarrow.compute as pc

    for lang in pc.unique(batch.column("lang")).to_pylist():
        rows = batch.filter(pc.equal(batch.column("lang"), lang)).column("bytes")
        yield lang, (t.as_py() for t in rows)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Grams]]:
    for batch in batches:
        for lang, texts in _by_language(batch):
            tail: list[bytes] = []
            for data, more in slices(texts):
                grams = Grams(data, tail if more else [])
                tail = grams.tail
                yield lang, grams


def _sketches(batches: Iterator[pa.RecordBatch], width: int, top: int) -> Iterator[pa.RecordBatch]:
    sketch, used = CountMin(width, top), False
    for lang, grams in _grams(batches):
        for at, h in grams.hashes(lang):
            sketch.add(h[at])
        used = True
    stripe = min(STRIPE, width)
    for row in range(DEPTH if used else 0):
        for k in range(width // stripe):
            cells = sketch.rows[row, k * stripe : (k + 1) * stripe]
            if cells.any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["row", "stripe", "cells"])


def _summed(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Which cells of each stripe reach `top`, as bits, from rows of whole stripes in order: one sum is held."""
    kind, key, total = np.min_scalar_type(2 * top), None, None

    def out() -> pa.RecordBatch:
        bits = np.packbits(total >= top, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["row", "stripe", "bits"])

    for batch in batches:
        for row, stripe, cells in zip(*(batch.column(c) for c in ("row", "stripe", "cells"))):
            more = np.frombuffer(cells.as_py(), kind)
            if key != (row.as_py(), stripe.as_py()):
                if key is not None:
                    yield out()
                key, total = (row.as_py(), stripe.as_py()), more
            else:
                total = np.minimum(total + more, top).astype(kind)
    if key is not None:
        yield out()


def sketched(texts: DataFrame, size: int, top: int) -> np.ndarray:
    """Bits (DEPTH rows) of the cells whose sum over all tasks reaches `top`. What comes to the driver has DEPTH * CELLS[1] bits at most."""
    width = CELLS[0]
    while width < CELLS[1] and width * BYTES_A_CELL < size:
        width *= 2
    spark = texts.sparkSession
    built = few_tasks(texts, size).mapInArrow(lambda it: _sketches(it, width, top), "row int, stripe int, cells binary")
    stripe = min(STRIPE, width)
    summed = built.repartition(parts(spark, DEPTH * width // stripe, 64), "row", "stripe").sortWithinPartitions("row", "stripe").mapInArrow(lambda it: _summed(it, top), "row int, stripe int, bits binary")
    out = np.zeros((DEPTH, width // 8), np.uint8)
    for row, k, bits in summed.collect():
        out[row, k * stripe // 8 : (k + 1) * stripe // 8] = np.frombuffer(bits, np.uint8)
    return out


def surviving(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their cells among the bits."""
    out = np.ones(len(h), bool)
    for row, at in zip(bits, cells_of(h, bits.shape[1] * 8)):
        out &= (row[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1 > 0
    return out


def survivors(grams: Grams, lang: str, bits: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(n, n-grams, counts) of the survivors of a slice, counted exactly: an n-gram's number comes from the number of its first words and its last word."""
    passed = np.ones(len(grams.ids), bool)
    number, base, names = grams.ids, max(1, len(grams.words)), grams.words
    for n, (_, h) in enumerate(grams.hashes(lang), 1):
        at = np.flatnonzero(grams.run >= n)
        if n > 1:  # both parts one word shorter must have passed
            at = at[passed[at] & passed[at - 1]]
        passed = np.zeros(len(grams.ids), bool)
        passed[at[surviving(bits, h[at])]] = True
        live = np.flatnonzero(passed)
        if not len(live):
            return
        code = number[live] if n == 1 else number[live - 1] * base + grams.ids[live]
        found, first, own = np.unique(code, return_index=True, return_inverse=True)
        names = [grams.words[k] for k in found] if n == 1 else [names[a] + b" " + grams.words[b] for a, b in zip((found // base).tolist(), (found % base).tolist())]
        number = np.full(len(grams.ids), -1, np.int64)
        number[live] = own
        # n-grams that end in carried words were counted before
        counts = np.bincount(own[live >= grams.fresh], minlength=len(found))
        yield n, names, counts


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], dict[bytes, int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, n), counts in held.items():
            phrases, numbers = list(counts), list(counts.values())
            for k in range(0, len(phrases), 10_000):
                size = len(phrases[k : k + 10_000])
                columns = [pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()), pa.array(phrases[k : k + 10_000], pa.binary()), pa.array(numbers[k : k + 10_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "phrase", "f"])

    for lang, grams in _grams(batches):
        total = held.setdefault((lang, 0), {b"": 0})
        total[b""] += len(grams)
        for n, names, counts in survivors(grams, lang, bits):
            own = held.setdefault((lang, n), {})
            for name, c in zip(names, counts.tolist()):
                if c:
                    own[name] = own.get(name, 0) + c
        if sum(map(len, held.values())) > HELD:
            yield from out()
            held.clear()
    yield from out()


def few_tasks(texts: DataFrame, size: int) -> DataFrame:
    """texts (size bytes) in tasks of about COUNTED bytes, but for all cores."""
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // COUNTED)))


def frequencies(docs: DataFrame, least: int) -> DataFrame:
    """(lang, n_words, phrase, f) of all n-grams of up to LONGEST words with f >= least in their language (null: UND), as written
    rows; with n_words 0 and no phrase, the number of all words of a language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    held = spark.sparkContext.broadcast(sketched(texts, size, least))  # DEPTH * CELLS[1] bits at most
    counted = few_tasks(texts, size).mapInArrow(lambda it: _counted(it, held.value), "lang string, n_words int, phrase binary, f long")
    return written(counted.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= F.when(F.col("n_words") > 0, least).otherwise(0)).withColumn("phrase", F.col("phrase").cast("string")))


def scored(found: DataFrame) -> DataFrame:
    """(lang, n_words, phrase, a, l, r, score) of each phrase of two words or more: the cut with the lowest score, then the fewest first words."""
    whole = F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(19,0)")
    cuts = found.where("n_words > 1").select("lang", "n_words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    words = F.split("phrase", " ")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice(words, 1, F.col("k")), " ").alias("part")), F.struct(F.lit(1).alias("side"), F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words")), " ").alias("part")))
    looked = cuts.select("lang", "n_words", "phrase", "a", "k", F.inline(sides)).join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = looked.groupBy("lang", "n_words", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    rated = both.withColumn("score", F.call_function("div", whole, F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")))
    least = rated.groupBy("lang", "n_words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    return least.select("lang", "n_words", "phrase", "a", "least.l", "least.r", "least.score")


def parts_of_longer(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): for each phrase inside longer ones, the count of the most frequent of those."""
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")))))
    return found.where("n_words > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mined(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language of docs (text, lang) by score, count and bytes.

    A phrase has 2 to LONGEST words and occurs `least` times or more within pieces, overlaps included. It is dropped if a longer such phrase contains it that
    has `share` in a hundred of its occurrences. Null texts are empty, null languages are UND; repeated rows count again; a
    language without such phrases, and an empty table, give no rows. Other columns are ignored.
    """
    found = frequencies(docs, least)
    whole = found.where("n_words = 0").select("lang", F.col("f").alias("n"))
    rated = scored(found).join(parts_of_longer(found), ["lang", "phrase"], "left")
    part = F.lit(100).cast("decimal(3,0)") * F.col("most").cast("decimal(19,0)") >= F.lit(share).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
    kept = rated.where(F.col("most").isNull() | ~part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark limits each task to `top` rows of a language before they meet.
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(whole, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
