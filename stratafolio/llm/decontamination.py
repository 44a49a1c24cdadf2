"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A document leaks an item if it holds at least `share` of the item's distinct shingles. Items are partitioned by their number of
shingles into classes [2**c, 2**(c+1)), each with a sketch table and a sketch size of its own. An item of q shingles that is contained may miss at most q - ceil(share * q), so of its smallest
hashes (a bottom-k MinHash) one more than its class can miss is enough: at least one of them is in the document, however long that is. A document's
shingles are therefore probed with the sketches alone, and each hit is verified against the item's shingles as bytes. No true leak is lost to chance, which a MinHash
of the document would risk for short items in long documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import Powers, hashed, plain_words

#: Bytes of benchmark text that go to the workers at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16_000_000


class SizeClass:
    """The items of `least` to 2 * least - 1 shingles: a table from the hashes of their sketches to the items. All have sketches of one
    size, one hash more than the largest item of the class can miss."""

    def __init__(self, least: int, share: float):
        most = 2 * least - 1
        self.size = most - math.ceil(share * most - 1e-9) + 1
        self.table: dict[int, list[int]] = defaultdict(list)

    def add(self, item: int, hashes: Iterable[int]) -> None:
        for h in sorted(hashes)[: self.size]:
            self.table[h].append(item)

    def candidates(self, hashes: set[int]) -> set[int]:
        return {item for h in self.table.keys() & hashes for item in self.table[h]}


class Sketches:
    """The items of one block: their shingles, and the sketches of each size class."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, share: float):
        self.powers, self.width, self.share = Powers(), width, share
        self.shingles: dict[int, set[bytes]] = {}
        self.classes: dict[int, SizeClass] = {}
        self.owner: dict[int, list[int]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            found = {int(h): joined[a:b] for joined, s, e, hs in hashed(plain_words(text), width, self.powers) for a, b, h in zip(s, e, hs)}
            if not found:
                continue
            self.shingles[k] = set(found.values())
            least = 1 << (len(found).bit_length() - 1)
            self.classes.setdefault(least, SizeClass(least, share)).add(k, found)
            for h in found:
                self.owner[h].append(k)
        self.ids = [i for i, _ in items]
        self.all = np.array(sorted(self.owner), np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.all >> np.uint64(44)).astype(np.int64)] = True

    def _held(self, hashes: np.ndarray) -> np.ndarray:
        """Where hashes are those of a shingle of some item: a sieve by their leading bits, then a search."""
        at = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        return at[self.all[np.minimum(np.searchsorted(self.all, hashes[at]), len(self.all) - 1)] == hashes[at]] if len(self.all) else at[:0]

    def found(self, text: bytes) -> list[dict]:
        words = plain_words(text)
        if not words:
            return []
        held: dict[int, set[bytes]] = defaultdict(set)  # no more than the block's own shingles, and their rare equals by hash
        for joined, starts, ends, hs in hashed(words, self.width, self.powers):
            at = self._held(hs)
            for h, a, b in zip(hs[at].tolist(), starts[at], ends[at]):
                held[h].add(joined[a:b])
        there_now = set(held)
        hit = set().union(*(c.candidates(there_now) for c in self.classes.values())) if held else set()
        out = []
        if hit:
            there = defaultdict(set)
            for h, found in held.items():
                for k in self.owner[h]:
                    if k in hit:
                        there[k] |= found & self.shingles[k]
            for k in sorted(hit):
                q = len(self.shingles[k])
                if len(there[k]) >= math.ceil(self.share * q - 1e-9):
                    out.append({"item_id": self.ids[k], "item_shingles": q, "shared": len(there[k])})
        return out


HITS = "array<struct<item_id:bigint,item_shingles:int,shared:int>>"


def _searcher(held, width: int, share: float):
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sketches = Sketches(held.value, width, share)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared", pa.int32())]))
        for batch in texts:
            yield pa.array([sketches.found(t.as_py() or b"") for t in batch], kind)

    search.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}  # the hints are read as types
    return F.arrow_udf(search, HITS)


def leaks_of(text: Column, benchmark: DataFrame, width: int = 5, share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> Column:
    """The items (of benchmark: item_id, text) that a text holds, as an array, in order of blocks and items.

    Words are runs of letters and digits, A-Z lowered. Items or texts of fewer than `width` words are one shingle, their whole
    sequence. Null and blank items hold nothing and are never found; null and blank texts hold nothing; items that repeat are
    reported as often as they occur.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes))
    tagged = items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        block = [(r.item_id, bytes(r.text)) for r in tagged.where(F.col("block") == b).collect()]  # about block_bytes
        held = benchmark.sparkSession.sparkContext.broadcast(sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        found.append(_searcher(held, width, share)(text.cast("binary")))
    return found[0] if len(found) == 1 else F.concat(*found)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): a row for each document and item that it leaks.

    A null doc_id stays null, repeated rows are reported as often as they occur; of hits of one document, the order is by block and item.
    One pass over the documents without a shuffle. Columns other than doc_id and text are ignored; an empty table or benchmark gives no rows.
    """
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaks_of(F.col("text"), benchmark, width, share).alias("hits"))
    return hit.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*", (F.col("h.shared") / F.col("h.item_shingles")).alias("containment"))
