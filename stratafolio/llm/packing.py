"""Packing token sequences into windows by best-fit decreasing.

Overlong documents are first cut into full windows; only the remainders compete for space. Best-fit
decreasing looks at lengths alone, and a window holds `capacity` tokens, so the whole corpus is
described by a histogram of at most `capacity` lengths. The plan is made on that histogram: equal
windows are kept as runs, a segment tree over remaining capacities finds the tightest open run, and
each step places as many pieces of one length as the run takes. The steps say which ranks of a length go
to which windows, and executors assign pieces by rank. The plan is exactly that of best-fit decreasing over
all pieces, its size depends on `capacity` and not on the corpus.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words whose ids a worker remembers, and their bytes; when full, the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64_000_000
#: Pieces of one length that are ranked together, were all of one length.
PER_SALT = 500_000
#: Documents whose unknown words are encoded together.
TOGETHER = 200
#: A mark set between words that are encoded as one string, and the words of such a string.
MARK, RUN = "\x01", 128
#: Separators for str.split() that the tokenizer's own white space does not contain.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class WordIds:
    """Little-endian ids of each word, encoded on first sight, many at once. The vocabulary's splitter never joins characters over
    white space, so a text's ids are those of its words. A worker keeps its words from task to task."""

    held: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0
        one, mark, two, all_three = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", MARK, "b", f"a {MARK} b"))
        self.mark = mark[0] if len(mark) == 1 and all_three == one + mark + two else None

    @classmethod
    def at(cls, path: str) -> WordIds:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def each(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word. Words with a mark between them are encoded as one string, which spares most of the cost of a call;
        where the marks don't come out one a gap, or the vocabulary has no id for the mark, each word is encoded by itself."""
        runs = [words[k : k + RUN] for k in range(0, len(words), RUN)]
        if self.mark is None:
            runs = [[w] for w in words]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            marks = 4 * np.flatnonzero(ids == self.mark) if len(run) > 1 else np.zeros(0, np.int64)
            if len(marks) != len(run) - 1 or (len(run) > 1 and any(MARK in w for w in run)):
                yield from map(self.encode, run)
                continue
            ids = ids.tobytes()
            yield from (ids[a:b] for a, b in zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(ids)]))

    def of(self, texts: list[str]) -> Iterator[bytes]:
        words = [None if any(c in t for c in ODD_SPACE) else t.split() for t in texts]
        if len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.known.clear()
            self.size = 0
        new = list(set().union(*(w for w in words if w)).difference(self.known))
        self.known.update(zip(new, self.each(new)))
        self.size += sum(map(len, new)) + sum(len(self.known[word]) for word in new)
        known = self.known.__getitem__
        for text, own in zip(texts, words):
            yield self.encode(text) if own is None else b"".join(map(known, own))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: full windows, then the remainder."""
    words, last = WordIds.at(path), np.array([end], "<u4").tobytes()
    step = 4 * capacity
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(k, TOGETHER)
            docs, start, length, crc, total = [], [], [], [], []
            for doc_id, own in zip(part.column(0).to_pylist(), words.of([t or "" for t in part.column(1).to_pylist()])):
                ids = own + last
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    docs.append(doc_id)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


class RemainingTree:
    """A segment tree whose leaf r tells whether a window with r tokens left is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.size)

    def set(self, r: int, on: bool) -> None:
        r += self.size
        self.full[r] = on
        while r > 1:
            r //= 2
            self.full[r] = self.full[2 * r] or self.full[2 * r + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open r >= least: climb until a right sibling has one, then go down its left edge."""
        r = least + self.size
        if self.full[r]:
            return least
        while r > 1:
            if r % 2 == 0 and self.full[r + 1]:
                r += 1
                while r < self.size:
                    r = 2 * r if self.full[2 * r] else 2 * r + 1
                return r - self.size
            r //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int, first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first window, offset) that place counts[length] pieces of
    each length, longest first, each into the tightest window with room, else into a new one. Windows are numbered from `first`."""
    tree, runs, steps, fresh = RemainingTree(capacity), [deque() for _ in range(capacity + 1)], [], first

    def leave(r: int, window: int, n: int) -> None:
        if r:
            if not runs[r]:
                tree.set(r, True)
            if runs[r] and sum(runs[r][-1]) == window:
                runs[r][-1] = (runs[r][-1][0], runs[r][-1][1] + n)
            else:
                runs[r].append((window, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r, window, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            else:
                window, n = runs[r].popleft()
                if not runs[r]:
                    tree.set(r, False)
            # A window just used is the tightest as long as it has room, so it takes the next equal pieces first.
            each = min(r // length, left)
            used = min(n, left // each)
            for k in range(each):
                steps.append((length, rank + k * used, used, window, capacity - r + k * length))
            rank, left = rank + each * used, left - each * used
            leave(r - each * length, window, used)
            if used < n:
                if not runs[r]:
                    tree.set(r, True)
                runs[r].appendleft((window + used, n - used))
    return steps


def assign(batches: Iterator[pa.RecordBatch], plan: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at, steps = length == n, plan[int(n)]
            step = steps[np.searchsorted(steps[:, 0], rank[at], "right") - 1]
            window[at], offset[at] = step[:, 1] + rank[at] - step[:, 0], step[:, 2]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(window), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 1, salts: int | None = None) -> DataFrame:
    """Every document of docs (doc_id, text) in windows of `capacity` tokens.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty
    text is its end token alone; repeated rows are packed as often as they occur; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows. Of equal lengths, the order is by salt, doc_id and start.
    Ranks are counted within (length, salt), so one very common length is spread over `salts` groups, as many as the pieces ask for.
    """
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: cut(it, tokenizer_path, capacity, end), PIECES))
    salts = salts or max(256, -(-pieces.count() // PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    per_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan: dict[int, list] = {}
    for length, rank, _, window, offset in best_fit_plan(per_length, capacity):
        plan.setdefault(length, []).append((rank, window, offset))
    arrays = docs.sparkSession.sparkContext.broadcast({n: np.array(steps, np.int64) for n, steps in plan.items()})  # bounded by capacity, not by the corpus
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", within - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(lambda it: assign(it, arrays.value), f"{PIECES}, sequence_id long, offset long")
