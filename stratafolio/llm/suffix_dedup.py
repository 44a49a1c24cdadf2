"""Suffix-array deduplication of repeated passages across and within documents.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Sorting every suffix of the corpus would write each byte many
times over, so the suffix array is sparse: of each window of `length` bytes the suffix at its smallest `seed`-byte hash, its
anchor, stands for it. The anchor depends on the window's content alone, so equal windows have equal anchors at equal places, and
windows in a row that share an anchor form its run. Then:

1. Texts that occur twice are all repeat if they are long enough; each distinct text is one text from here on. A seed in one place only has no repeat; a run
   whose whole context (all bytes of its windows) is in two places is all repeat. Both are settled by counts, without any text.
2. The contexts left, one of each kind, are range-partitioned as suffixes from their anchor by sampled splitters on the leading bytes, then the hash of
   the seed. Equal seeds have equal keys, so no splitter parts two suffixes that share a seed and no repeat crosses the boundary of two buckets.
3. Each bucket sorts its suffixes by multikey quicksort, and the bytes before the anchors, read backwards, likewise. Common prefixes of
   neighbours in both orders decide: two windows that start d bytes before their anchors are equal if and only if the suffixes share
   length - d bytes and the bytes before them d.
4. A seed with too many contexts for a bucket is not compared there: its runs are cut into narrower ones, `NARROW` windows and then one, whose
   seeds are all bytes that their windows share. Steps 1 to 3 settle those, down to single windows, which counts alone settle.
5. Ranges of repeated windows go back to their documents, which cut them out in one pass.

Buckets compare bytes. Counts go by two 64-bit hashes, of seed and context, drawn independently of each other's bytes: two different contexts
among 10**12 are taken for equal with a chance of about 10**-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, written
from .shingles import Powers

#: Windows hashed at once in a long text.
BLOCK = 1 << 19
#: Low bits of a sort key that hold the position within a block.
PLACE = np.uint64((1 << 24) - 1)
#: Bytes of contexts that a bucket may hold.
BUCKET_BYTES = 24_000_000
#: Contexts of one seed that a bucket compares; runs of seeds with more are cut into runs of so many windows.
GROUP, NARROW = 20_000, (16, 1)
#: Keys of texts that a task remembers, to skip further copies. Those it misses are found by the counts.
REMEMBERED = 1_000_000
#: Seeds and kinds of runs with more than one in SHARE of all rows are joined by broadcast: there are fewer than SHARE of them.
SHARE = 10_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row: running minima from both sides of blocks of that width."""
    n = len(a)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = a
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int, seed: int, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with the same anchor: seed hash, context hash, first and last window, anchor."""
    for at in range(0, len(text) - length + 1, BLOCK):
        data = np.frombuffer(text[at : at + BLOCK + length - 1], np.uint8)
        total = powers.prefix(data)
        h = mixed((total[seed:] - total[:-seed]) * powers.down[: len(total) - seed])
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_minimum(key, length - seed + 1) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        last = np.append(first[1:], len(least)) - 1
        context = mixed((total[last + length] - total[first]) * powers.down[first] + (last - first).astype(np.uint64))
        yield h[least[first]].view(np.int64), context.view(np.int64), first + at, last + at, least[first] + at


def _anchors(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    powers, seen = Powers(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            found, keys = [[] for _ in range(5)], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                for columns in anchors(text.as_py() or b"", length, seed, powers):
                    keys += [key] * len(columns[0])
                    for out, c in zip(found, columns):
                        out.append(c)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(np.concatenate(c)) for c in found)], names=["key", "h", "x", "lo", "hi", "m"])


CONTEXTS = "h long, x long, key binary, lo long, hi long, m long, many boolean, giant boolean, context binary"
CONTEXT_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
CONTEXT_NAMES = ["h", "x", "key", "lo", "hi", "m", "many", "giant", "context"]


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), CONTEXT_KINDS)], names=CONTEXT_NAMES)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes under each wanted run."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text, wanted in zip(batch.column("key"), batch.column("text"), batch.column("wanted")):
            key, text = key.as_py(), text.as_py()
            for w in wanted.as_py():
                rows.append((w["h"], w["x"], key, w["lo"], w["hi"], w["m"], w["many"], w["giant"], text[w["lo"] : w["hi"] + length]))
                if len(rows) > 20_000:
                    yield _context_rows(rows)
                    rows = []
        if rows:
            yield _context_rows(rows)


def _narrowed(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Each context's run cut where the distance to the anchor is a multiple of width; the new anchor and seed are what all windows of
    such a piece share."""
    from xxhash import xxh3_64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            near, far = r["m"] - r["hi"], r["m"] - r["lo"]
            for c in range(near // width, far // width + 1):
                a, b = max(near, c * width), min(far, c * width + width - 1)
                lo, hi, m = r["m"] - b, r["m"] - a, r["m"] - c * width
                core = r["context"][m - r["lo"] : m - r["lo"] + length - width + 1]
                piece = r["context"][lo - r["lo"] : hi - r["lo"] + length]
                rows.append((signed(xxh3_64_intdigest(core, c)), signed(xxh3_64_intdigest(piece, b)), r["key"], lo, hi, m, r["many"], False, piece))
            if len(rows) > 20_000:
                yield _context_rows(rows)
                rows = []
        if rows:
            yield _context_rows(rows)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words: three-way partition by the median of one word, and the next word only
    among equals."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= 24:
            order[a:b] = sorted(part, key=lambda i: words[i, depth:].tolist())
            continue
        w = words[part, depth]
        pivot = np.partition(w, len(w) // 2)[len(w) // 2]
        less, equal = part[w < pivot], part[w == pivot]
        order[a:b] = np.concatenate((less, equal, part[w > pivot]))
        c, d = a + len(less), a + len(less) + len(equal)
        stack += [(a, c, depth), (c, d, depth + 1), (d, b, depth)]
    return order


RANGES = "key binary, lo long, hi long"


def common_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row (of bytes, a multiple of eight) in sorted order, and the bytes that each place's row shares with the one before."""
    order = multikey_quicksort(rows.view(">u8").astype(np.uint64))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 8192):
        k = np.arange(at, min(at + 8192, len(order)))
        other = rows[order[k]] != rows[order[k - 1]]
        shared[k] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return place, shared


def repeated_windows(contexts: list[bytes], near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """For each context (a row) and distance to the anchor (a column), whether another context has the same window. The windows
    of a context start near to far bytes before its anchor, which is far bytes into it."""
    n, most = len(contexts), int(far.max())
    right = np.zeros((n, -(-length // 8) * 8), np.uint8)
    left = np.zeros((n, max(8, -(-most // 8) * 8)), np.uint8)
    for k, c in enumerate(contexts):
        data = np.frombuffer(c, np.uint8)
        right[k, : len(c) - far[k]] = data[far[k] :]
        left[k, : far[k]] = data[: far[k]][::-1]
    (r_place, r_shared), (l_place, l_shared) = common_prefixes(right), common_prefixes(left)
    out = np.zeros((n, most + 1), bool)
    for d in range(int(near.min()), most + 1):
        at = np.flatnonzero((near <= d) & (d <= far))
        if len(at) < 2:
            continue
        kind = np.cumsum(r_shared < length - d)[r_place[at]] * (n + 1) + np.cumsum(l_shared < d)[l_place[at]]
        order = np.argsort(kind, kind="stable")
        same = kind[order[1:]] == kind[order[:-1]]
        out[at[order], d] = np.append(same, False) | np.append(False, same)
    return out


def _bucket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of the contexts of one bucket that counts have not settled."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held)
    lo, hi, m = (got.column(c).to_numpy() for c in ("lo", "hi", "m"))
    twice = repeated_windows(got.column("context").to_pylist(), m - hi, m - lo, length)
    twice[got.column("many").to_numpy(zero_copy_only=False)] = False
    edge = np.diff(np.pad(twice.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, first), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    yield pa.RecordBatch.from_arrays([got.column("key").combine_chunks().take(pa.array(row)), pa.array(m[row] - stop + 1), pa.array(m[row] - first)], names=["key", "lo", "hi"])


def cut_out(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and the rest, for runs of window starts (first, last)."""
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return len(text), sum(b - a for a, b in spans), len(spans), b"".join([*kept, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [cut_out(text.as_py() or b"", [(r["lo"], r["hi"]) for r in runs.as_py() or []], length) for text, runs in zip(batch.column("text"), batch.column("runs"))]
        n, removed, spans, kept = zip(*out) if out else ((), (), (), ())
        digests, texts = [hashlib.sha256(k).hexdigest() for k in kept], [k.decode("utf-8", "ignore") for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


RUN = ("key", "lo", "hi", "m")


def joined(rows: DataFrame, keys: DataFrame, on: list[str], large: Column) -> DataFrame:
    """rows with their keys: the large keys by broadcast, so that no task gets all rows of one, the others by a shuffle. `keys` is read twice."""
    often = keys.where(large)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(keys.where(~large), on)
    return rows.join(F.broadcast(often), on).unionByName(rest)


def frequent(rows: int) -> Column:
    return F.col("places") > max(2, rows // SHARE)


def kinds_of(runs: DataFrame, *more: str) -> DataFrame:
    """(h, x, places, many, one): each kind of run, its rows, whether it is in several places, and the first of them."""
    place = F.struct("key", "lo")
    return runs.groupBy("h", "x").agg(F.count("*").alias("places"), (F.min(place) != F.max(place)).alias("many"), F.min(F.struct(*RUN, *more)).alias("one"))


def to_compare(kinds: DataFrame) -> DataFrame:
    """kinds that counts leave open and those they must be compared with: of seeds with several kinds, one at least in a single place."""
    counted = kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("many").alias("all_many")).where("n > 1 AND NOT all_many")
    open_seeds = written(counted.select("h", (F.col("n") > GROUP).alias("giant")))
    return joined(kinds, open_seeds, ["h"], F.col("giant"))


def compared(contexts: DataFrame, length: int, size: int) -> DataFrame:
    buckets = contexts.withColumn("lead", F.substr("context", F.col("m") - F.col("lo") + 1, F.lit(16))).repartitionByRange(parts(contexts.sparkSession, size, BUCKET_BYTES), "lead", "h")  # sampled splitters
    return buckets.mapInArrow(lambda it: _bucket(it, length), RANGES)


def narrowed_ranges(giants: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """Ranges of repeated windows of contexts whose seed has too many of them for a bucket."""
    pieces = written(giants.mapInArrow(lambda it: _narrowed(it, length, widths[0]), CONTEXTS))
    counted = pieces.groupBy("h", "x").agg(F.count("*").alias("places"), (F.min(F.struct("key", "lo")) != F.max(F.struct("key", "lo"))).alias("several"), F.max("many").alias("settled"), F.min(F.struct(*RUN, "context")).alias("one"))
    kinds = written(counted.select("h", "x", "places", (F.col("several") | F.col("settled")).alias("many"), "one"))
    out = joined(pieces.where("NOT many"), kinds.where("many").select("h", "x", "places"), ["h", "x"], frequent(pieces.count())).select("key", "lo", "hi")
    if len(widths) == 1:
        return out
    rest = written(to_compare(kinds).select("h", "x", *(f"one.{c}" for c in RUN), "many", "giant", "one.context"))
    size = rest.where("NOT giant").agg(F.sum(F.length("context"))).first()[0] or 0
    return out.unionByName(compared(rest.where("NOT giant"), length, size)).unionByName(narrowed_ranges(rest.where("giant"), length, widths[1:]))


def repeated_runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, runs): runs of repeated window starts for each text, known by its key."""
    spark = docs.sparkSession
    found = written(docs.select("key", "text").mapInArrow(lambda it: _anchors(it, length, seed), "key binary, h long, x long, lo long, hi long, m long"))
    place = F.xxhash64("key", "lo")
    counted = found.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("places"))
    again = written(counted.where("a <> b").select("h", "places"))
    shared = written(joined(found, again, ["h"], frequent(found.count())).select("h", "x", *RUN))
    kinds = written(kinds_of(shared))
    ranges = [joined(shared, kinds.where("many").select("h", "x", "places"), ["h", "x"], frequent(shared.count())).select("key", "lo", "hi")]
    wanted = written(to_compare(kinds).select("h", "x", *(f"one.{c}" for c in RUN), "many", "giant"))
    sizes = {r.giant: r.size for r in wanted.groupBy("giant").agg(F.sum(F.col("hi") - F.col("lo") + length).alias("size")).collect()}
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "x", "lo", "hi", "m", "many", "giant")).alias("wanted"))
    contexts = docs.select("key", "text").dropDuplicates(["key"]).join(per_text, "key").mapInArrow(lambda it: _contexts(it, length), CONTEXTS)
    if True in sizes:
        contexts = written(contexts)
        ranges.append(narrowed_ranges(contexts.where("giant"), length, NARROW))
    ranges.append(compared(contexts.where("NOT giant"), length, int(sizes.get(False, 0))))
    copies = docs.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("size")).where("n > 1")
    ranges.append(copies.select("key", F.lit(0).cast("long").alias("lo"), (F.col("size") - length).cast("long").alias("hi")))
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    return written(every.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def deduplicated(docs: DataFrame, length: int = 400, seed: int = 128, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text), texts as UTF-8 bytes, and on request `text`, what
    is left; where a cut falls inside a character, its remaining bytes are left out there (the hash has them).

    A null text is empty; texts shorter than `length` lose nothing; rows that repeat a text lose all of it if it is long enough, since each string
    also starts in the other; an empty table gives no rows; a null doc_id stays null; other columns are ignored. Judged on the input, whole texts.
    `seed` is at most `length`.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"), F.unhex(F.md5(raw)).alias("key"))
    runs = repeated_runs(keyed.where(F.length("text") >= length), length, seed)
    out = keyed.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(lambda it: _cut(it, length), COLUMNS)
    return out if with_text else out.drop("text")
