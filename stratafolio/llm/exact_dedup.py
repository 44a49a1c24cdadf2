"""Exact deduplication by counting quotient filters and a comparison of bytes.

Each task puts the fingerprints of its rows into a counting quotient filter: a fingerprint is a block, a quotient and a remainder; the
remainders of a quotient stand sorted in one run, equal ones once with a count. Filters of one block merge losslessly, because
sorted runs merge and counts add up. Fingerprints whose count ends above one go to the comparison: the rows that
may have them are grouped by their whole normalised text. All other rows are alone, and their texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, dropped, parts, written

QUOTIENT_BITS, REMAINDER_BITS = 16, 32
#: Fingerprints of a block, about; blocks are the unit of merging and grow in number with the rows.
PER_BLOCK = 1 << 18
#: Fingerprints that a task holds before its filters go out; what follows starts new ones, which merge with them.
HELD = 1 << 20
#: The routing table has the first bits of the repeated fingerprints, so it holds 2**ROUTE_BITS numbers at most at any size.
ROUTE_BITS = 20
#: Groups with more than one in SHARE of all rows are joined by broadcast: there are fewer than SHARE of them.
SHARE = 10_000


class CountingQuotientFilter:
    """Fingerprints below 2**(QUOTIENT_BITS + REMAINDER_BITS) with counts, as four arrays: the quotients that occur, the length of each
    one's run, the remainders run after run, and their counts."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """fingerprints (uint64) in ascending order, each once."""
        quotients, runs = np.unique((fingerprints >> np.uint64(REMAINDER_BITS)).astype(np.uint16), return_counts=True)
        return cls(quotients, runs.astype(np.uint32), fingerprints.astype(np.uint32), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(REMAINDER_BITS) | self.remainders

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Nothing is lost: a remainder stands once in its run, with the sum of both counts."""
        both = np.concatenate((self.fingerprints(), other.fingerprints()))
        order = np.argsort(both, kind="stable")  # two sorted runs: a merge
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        sums = np.add.reduceat(np.concatenate((self.counts, other.counts))[order], first) if len(both) else self.counts
        return CountingQuotientFilter.of(both[first], sums)

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.quotients, self.runs, self.remainders, self.counts)]

    @classmethod
    def of_row(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(np.frombuffer(quotients, np.uint16), np.frombuffer(runs, np.uint32), np.frombuffer(remainders, np.uint32), np.frombuffer(counts, np.int64))


FILTER = "block int, quotients binary, runs binary, remainders binary, counts binary"
NAMES = ["block", "quotients", "runs", "remainders", "counts"]
_LOW = np.uint64((1 << (QUOTIENT_BITS + REMAINDER_BITS)) - 1)


def _block(fp: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each fingerprint, by its upper bits; the lower ones are its quotient and remainder."""
    return ((fp >> np.uint64(QUOTIENT_BITS + REMAINDER_BITS)) * np.uint64(blocks) >> np.uint64(64 - QUOTIENT_BITS - REMAINDER_BITS)).astype(np.int64)


def _filters(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        fp, counts = np.unique(np.concatenate(held), return_counts=True)
        at = _block(fp, blocks)
        order = np.lexsort((fp & _LOW, at))
        fp, counts, at = fp[order] & _LOW, counts[order], at[order]
        # Fingerprints of one block that differ above the quotient only are one here, as in any table of shorter fingerprints.
        new = np.append(True, (fp[1:] != fp[:-1]) | (at[1:] != at[:-1]))
        first = np.flatnonzero(new)
        fp, counts, at = fp[first], np.add.reduceat(counts, first), at[first]
        edges = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows = [(int(at[a]), *CountingQuotientFilter.of(fp[a:b], counts[a:b]).row()) for a, b in zip(edges, np.append(edges[1:], len(at)))]
        for k in range(0, len(rows), 256):
            columns = list(zip(*rows[k : k + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=NAMES)

    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy().view(np.uint64))
        if sum(map(len, held)) >= HELD:
            yield from out()
            held = []
    if held:
        yield from out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated fingerprints of the blocks of a partition, which holds whole blocks in order; one merged filter is held."""
    block, filter_ = None, None

    def out() -> pa.RecordBatch:
        fp = filter_.repeated()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), block, np.int32)), pa.array(fp.view(np.int64))], names=["block", "low"])

    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            if block is not None and b != block:
                yield out()
                filter_ = None
            more = CountingQuotientFilter.of_row(*row)
            block, filter_ = b, more if filter_ is None else filter_.merged(more)
    if block is not None:
        yield out()


def repeated_fingerprints(rows: DataFrame, n: int) -> DataFrame:
    """(block, low) of the fingerprints (column fp) that more than one of n rows may have."""
    blocks = min(1 << 15, parts(rows.sparkSession, n, PER_BLOCK))
    filters = rows.select("fp").mapInArrow(lambda it: _filters(it, blocks), FILTER)
    return filters.repartition(parts(rows.sparkSession, n, PER_BLOCK), "block").sortWithinPartitions("block").mapInArrow(_merged, "block int, low long")


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _route(low: Column) -> Column:
    """The first bits of what a filter keeps of a fingerprint: of its quotient and remainder."""
    return F.shiftrightunsigned(low, QUOTIENT_BITS + REMAINDER_BITS - ROUTE_BITS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text); other columns are ignored.

    Texts are equal if their normalised forms are, byte for byte; null counts as empty, and blank texts are one space. keep_id is the
    least doc_id of the group; null ids are never the least, so it is null where all are. Exactly one row of each group is kept: where several have the
    least id (rows that repeat), one of them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    rows = written(texts.select("doc_id", "fp", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    low = F.col("fp").bitwiseAND(F.lit(int(_LOW)))
    repeated = written(repeated_fingerprints(rows, n).select(_route(F.col("low")).alias("route")).distinct())  # 2**ROUTE_BITS rows at most
    sought = texts.join(F.broadcast(repeated), _route(low) == F.col("route"), "left_semi")
    same = sought.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size")).where("size > 1")
    groups = written(same.select(F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "keep_id", "size"))
    named = _joined(rows, groups, n)
    # Several rows of a group may have its least id; the first of them stays.
    first = named.where("size > 1 AND doc_id <=> keep_id").groupBy("sha").agg(F.min("row").alias("first"))
    groups = written(groups.join(first, "sha"))
    dropped(repeated)
    size = F.coalesce("size", F.lit(1)).cast("long")
    return _joined(rows, groups, n).select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        size.alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _joined(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """rows with their groups: the largest groups by broadcast, so that no task gets all rows of one, the others by a shuffle."""
    large = F.col("size") > max(2, n // SHARE)
    marked = groups.select("sha", F.struct(*(c for c in groups.columns if c != "sha")).alias("g"), large.alias("large"))
    hot = rows.join(F.broadcast(marked.where("large").select("sha", F.col("g").alias("hot"))), "sha", "left")
    rest = hot.where("hot IS NULL").drop("hot").join(marked.where("NOT large").select("sha", "g"), "sha", "left").select(*rows.columns, "g.*")
    return hot.where("hot IS NOT NULL").select(*rows.columns, "hot.*").unionByName(rest)
