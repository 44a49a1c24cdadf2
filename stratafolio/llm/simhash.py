"""SimHash near-duplicates by generalised pigeonhole search.

A fingerprint is a bitwise majority over the XXH64 of all word shingles. Distinct fingerprints are searched
for pairs within `distance` bits: the 64 bits are cut into m groups of correlated bits, and group i gets
a threshold t_i >= -1 with sum t_i = distance - m + 1; any pair within `distance` agrees to t_i bits in some group. Dynamic
programming allots the thresholds, and m itself is chosen, by estimated probes and candidates. A group with t_i
probes each fingerprint's bits with up to t_i set bits cleared, so two keys within t_i bits meet at their common
part. Every meeting is verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, written
from .components import components

BITS = 64
#: Cost of one probe row (built, shuffled, sorted) and one candidate (verified), relative.
PROBE_COST, VERIFY_COST = 1.0, 0.02
#: Rows of one key that are searched as one block; keys with more are searched block against block.
BLOCK = 2048
#: Blocks of at most so many rows are searched pair by pair, larger ones from row to row.
SMALL = 48


def fingerprint(text: bytes, width: int) -> int:
    """Of UTF-8 bytes; A-Z are lowered and words are what ASCII white space separates."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :] or ends[-1:])], "<u8")
    if len(hashes) == 1:
        return int(hashes[0])
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of docs; null text counts as empty, with fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 8192):
            bits = np.unpackbits(fp[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        n += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel(), float(n)], pa.float64())], names=["k", "v"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, share of ones in each bit, and correlation of the bits, over all fingerprints."""
    sums = dict(distinct.select("fp").mapInArrow(_together, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect())  # 4097 rows
    n = int(sums.get(BITS * BITS, 0))
    both = np.array([sums.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS) / max(n, 1)
    ones = both.diagonal().copy()
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return n, ones, (both - np.outer(ones, ones)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size: each grows from a free bit by the bit most correlated with it."""
    free, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (sum(abs(correlation[b, x]) for x in group), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def agreement(ones: np.ndarray, group: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in at most t bits of the group, for each t."""
    chance = np.array([1.0])
    for b in group:
        differ = 2 * ones[b] * (1 - ones[b])
        chance = np.append(chance * (1 - differ), 0) + np.append(0, chance * differ)
    return np.cumsum(chance)


def allot(n: int, ones: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds with the least estimated cost; dynamic programming over groups and what is left to allot."""
    m = len(groups)
    total = distance - m + 1

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        set_bits = sum(ones[b] for b in groups[i])
        probes = sum(math.prod(set_bits - j for j in range(k)) / math.factorial(k) for k in range(t + 1))
        return n * probes * PROBE_COST + n * n / 2 * agreement(ones, groups[i])[min(2 * t, len(groups[i]))] * VERIFY_COST

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                if used + t <= total + (m - 1 - i):
                    x = (c + cost(i, t), [*ts, t])
                    if used + t not in step or x < step[used + t]:
                        step[used + t] = x
        best = step
    return best[total]


def plan(distinct: DataFrame, distance: int) -> tuple[int, list[tuple[list[int], int]]]:
    n, ones, correlation = bit_statistics(distinct)
    options = []
    for m in range(1, distance + 2):
        if BITS / m <= 32 or m == distance + 1:
            groups = group_bits(correlation, m)
            options.append((*allot(n, ones, groups, distance), groups))
    _, thresholds, groups = min(options, key=lambda x: x[0])
    return n, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def _keys(batches: Iterator[pa.RecordBatch], groups: list[tuple[list[int], int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i, (bits, t) in enumerate(groups):
            own = np.zeros(len(fp), np.uint64)
            for at, b in enumerate(bits):
                own |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
            for level in range(t + 1):
                for cleared in combinations(range(len(bits)), level):
                    mask = np.uint64(sum(1 << c for c in cleared))
                    at = (own & mask) == mask
                    k = own[at] & ~mask
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(k.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["part", "key", "fp"])


def _small_links(size: np.ndarray, start: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within many small blocks at once: row r of a block against row r + gap."""
    if not len(size):
        return
    for gap in range(1, int(size.max())):
        at = size > gap
        n = size[at] - gap
        first = np.repeat(start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        near = np.bitwise_count(fp[first] ^ fp[first + gap]) <= distance
        yield fp[first[near]], fp[first[near] + gap]


def _spanning(fp: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that connect what is connected within a block: each row reached looks once at the rows not reached yet."""
    a, b, rest = [], [], fp
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            u = stack.pop()
            near = np.bitwise_count(rest ^ u) <= distance
            if near.any():
                got = rest[near]
                a += [u] * len(got)
                b += list(got)
                stack += list(got)
                rest = rest[~near]
    return a, b


def _search(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of each block of a partition; a partition holds whole blocks."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    got = pa.Table.from_batches(held)
    columns = [got.column(c).to_numpy() for c in ("part", "key", "lo", "hi")]
    fp = got.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fp, *columns[::-1]))
    columns, fp = [c[order] for c in columns], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    again = ~new
    again[1:] &= fp[1:] == fp[:-1]
    again[0] = False
    start = np.flatnonzero(new[~again])
    fp = fp[~again]
    size = np.diff(np.append(start, len(fp)))
    small = (size > 1) & (size <= SMALL)
    for a, b in _small_links(size[small], start[small], fp, distance):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        a, b = _spanning(fp[s : s + n], distance)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all that is connected by steps of at most `distance` bits.

    Keys with more than BLOCK rows are cut into blocks by a hash of the fingerprint and each pair of blocks is searched, so
    no task holds a whole hot key.
    """
    spark = distinct.sparkSession
    n, groups = plan(distinct, distance)
    probes = sum(sum(math.comb(len(g), k) / 2**k for k in range(t + 1)) for g, t in groups)
    keyed = distinct.select("fp").mapInArrow(lambda it: _keys(it, groups), "part int, key long, fp long")
    hot = written(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = keyed.join(hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return dealt.repartition(parts(spark, int(n * probes), 1_000_000), "part", "key", "lo", "hi").mapInArrow(lambda it: _search(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by steps of at most `distance` differing bits, itself included. Null
    and blank texts have fingerprint 0 and link like any other; rows that repeat a doc_id are one node each and share
    the result of their fingerprint; null doc_ids never name a component, so one is null where all are; an empty table gives no rows.
    """
    found = written(fingerprints(docs, width))
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct, distance))
    named = distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "component").select("fp", "component_id"))
    return found.join(named, "fp")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
