"""Importance resampling of documents towards a target collection, by hashed word n-grams.

Features are all runs of one to `LONGEST` words, hashed into buckets. Each bucket has a gain, the logarithm of how much more frequent it is in
the target; the weight of a text is the sum of its features' gains. Identical texts are collapsed first, by grouping the full text:
features are computed once a text and stored as a sparse histogram, counts are multiplied by the number of copies, and weights are
joined back to the documents before each gets noise of its own. The highest scores are drawn (weighted sampling without
replacement by Gumbel noise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, parts, written

BUCKETS, LONGEST = 10_000, 3
#: Bytes of a text whose words are taken at once; the last words are carried over.
SLICE = 1 << 20
#: Texts with more than one in SHARE of all rows are joined by broadcast: there are fewer than SHARE of them.
SHARE = 10_000
#: Rows of a partition of the final order.
ORDERED = 1_000_000

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_CLEAN = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def histogram(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and how often each bucket occurs among the features of the whole text (UTF-8)."""
    from zlib import crc32

    total, n, carried, at = np.zeros(BUCKETS, np.int64), 0, [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] in _WORD + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":  # never inside a word
            end += 1
        new = text[at:end].translate(_CLEAN).split()
        at, n = end, n + len(new)
        words = carried + new
        spaced = [b" " + w for w in words]
        have, codes = list(map(crc32, words)), []
        for k in range(LONGEST):
            # have[i] is the feature of the k + 1 words from i; those that end in carried words were counted before
            codes.append(np.array(have[max(0, len(carried) - k) :], np.int64) % BUCKETS)
            have = list(map(crc32, spaced[k + 1 :], have))
        total += np.bincount(np.concatenate(codes), minlength=BUCKETS)
        carried = words[-(LONGEST - 1) :]
    return n, total


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets that occur, as steps from one to the next, and their counts."""
    at = np.flatnonzero(counts)
    return np.diff(at, prepend=0).astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()


def unpacked(steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.int64), np.frombuffer(counts, "<u4").astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            piece = batch.slice(k, 500)
            got = [histogram(t.as_py()) for t in piece.column("bytes")]
            stored = [packed(h) for _, h in got]
            columns = [piece.column("sha"), piece.column("copies"), pa.array([n for n, _ in got], pa.int64()), pa.array([s for s, _ in stored], pa.binary()), pa.array([c for _, c in stored], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sha", "copies", "words", "steps", "counts"])


def features(texts: DataFrame) -> DataFrame:
    """(sha, copies, words, steps, counts) for each distinct text of texts (text): copies that a task has of a text are one before the shuffle. Null counts as empty."""
    collapsed = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    rows = collapsed.select(digest(F.col("text")).alias("sha"), "copies", F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(_features, "sha binary, copies long, words long, steps binary, counts binary")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for copies, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("copies", "steps", "counts"))):
            at, n = unpacked(steps, counts)
            total[at] += n * copies
    yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(total)], names=["bucket", "n"])


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) for each of the BUCKETS buckets; none where there are no texts."""
    return found.select("copies", "steps", "counts").mapInArrow(_sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket in thousandths, from the features of both sides; BUCKETS numbers of each come to the driver."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for side, found in ((s, raw), (t, target)):
        for bucket, n in bucket_counts(found).collect():
            side[bucket] = n
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(sha, copies, words, n_features, weight) for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [unpacked(s, c) for s, c in zip(batch.column("steps").to_pylist(), batch.column("counts").to_pylist())]
            n, w = [int(c.sum()) for _, c in got], [int((gain[at] * c).sum()) for at, c in got]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sha", "copies", "words")), pa.array(n, pa.int64()), pa.array(w, pa.int64())], names=["sha", "copies", "words", "n_features", "weight"])

    return found.mapInArrow(run, "sha binary, copies long, words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of seed and id; a null id counts as the text null."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def numbered(rows: DataFrame, order: list[Column], name: str, n: int) -> DataFrame:
    """rows with their place (from 1) in a total order, as column `name`: ranges are sorted apart and start where those before them end."""
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(parts(spark, n, ORDERED), *order).withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range").count().orderBy("range").collect()  # a row a range
    starts, at = [], 0
    for r in ends:
        starts.append((r["range"], at))
        at += r["count"]
    if not starts:
        return ranged.drop("range").withColumn(name, F.lit(0).cast("long"))
    offsets = spark.createDataFrame(starts, "range int, start long")
    place = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "range").withColumn(name, place).drop("range", "start")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs (doc_id, text), weighed towards target (text); other columns are ignored.

    rank numbers what is drawn: the `percent` in a hundred, rounded down, highest scores of the documents with `least_words` words or
    more, ties by the smaller doc_id, null ids last; rows that tie in that too (repeats) are drawn in any order. Null and blank
    texts have no features and weight 0. Rows that repeat an id get the same noise. Without documents there are no rows; with an empty target
    all gains come from the smoothing.
    """
    raw, aim = written(features(docs.select("text"))), written(features(target.select("text")))
    weighed = written(weights(raw, gains(raw, aim)))
    dropped(raw, aim)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha"))
    n = weighed.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("words") >= least_words, F.col("copies"))), F.lit(0))).first()
    large = F.col("copies") > max(2, n[0] // SHARE)
    values = F.struct("words", "n_features", "weight")
    hot = rows.join(F.broadcast(weighed.where(large).select("sha", values.alias("hot"))), "sha", "left")
    rest = hot.where("hot IS NULL").select("doc_id", "sha").join(weighed.where(~large).select("sha", values.alias("hot")), "sha").select("doc_id", "hot.*")
    joined = hot.where("hot IS NOT NULL").select("doc_id", "hot.*").unionByName(rest)
    scored = joined.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("words") < least_words)
    # tie spreads rows that agree in all else over the ranges
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    placed = numbered(scored.withColumn("tie", F.monotonically_increasing_id()), order, "place", n[0])
    drawn = percent * n[1] // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when((F.col("place") <= drawn) & ~F.col("short"), F.col("place")).alias("rank"))
