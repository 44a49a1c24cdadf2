"""Groups of near copies by Jaccard similarity of word shingles.

Rows with equal sets of shingles are one node. The nodes to compare come from the generalised pigeonhole search over SimHash fingerprints (simhash.py),
and, since a pair at the least similarity may lie far beyond any distance that can be searched, from MinHash bands: such a pair misses
all bands with a chance below 2e-7. Candidates that hang together form a component, and inside it sets are compared exactly,
so a link is always verified. Large components are cut into blocks and searched block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, written
from .components import components
from .shingles import Powers, hashed
from .simhash import fingerprint, links

#: Differing bits within which fingerprints are compared.
DISTANCE = 4
BANDS, ROWS = 40, 5
_RNG = np.random.default_rng(20240301)
FLIPS, FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64), _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes of one component that are compared as one block.
BLOCK = 256
#: Shingles that are hashed for the bands at once.
CHUNK = 2048
NODE = "row long, node long, fp long, keys array<long>"


def shingle_set(text: bytes, width: int, powers: Powers) -> np.ndarray:
    """Distinct hashes in order; A-Z are lowered and words are what ASCII white space separates. Blank texts have none."""
    blocks = [hs for _, _, _, hs in hashed(text.lower().split(), width, powers)] if text.strip() else []
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.minimum.reduce([((shingles[k : k + CHUNK, None] ^ FLIPS) * FACTORS).min(axis=0) for k in range(0, len(shingles), CHUNK)])
    return np.array([xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    powers, row = Powers(), TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            sets = [shingle_set(t.as_py() or b"", width, powers) for t in piece.column(1)]
            node = np.array([xxh64_intdigest(s.tobytes(), 0) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint(t.as_py() or b"", width) for t in piece.column(1)], np.uint64).view(np.int64)
            rows = np.arange(row, row + len(sets))
            row += len(sets)
            columns = [piece.column(0), pa.array(rows), pa.array(node), pa.array(fp), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "node", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            sets = [shingle_set(t.as_py() or b"", width, powers).tobytes() for t in piece.column("text")]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("component", "blocks", "node")), pa.array(sets, pa.binary())], names=["component", "blocks", "node", "shingles"])


def spanning(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Verified pairs that connect all sets that verified pairs connect: each one reached looks once at those not reached yet."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    left, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack and left.any():
            u = stack.pop()
            own = np.zeros(ids.max() + 1, np.int64)
            own[ids[start[u] : start[u] + size[u]]] = 1
            both = np.add.reduceat(own[ids], start)
            near = np.flatnonzero(left & (both >= share * (size + size[u] - both) - 1e-9))
            left[near] = False
            out += [(u, int(v)) for v in near]
            stack += near.tolist()
    return out


def _compare(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks of a partition; a partition holds whole blocks."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held)
    columns = [got.column(c).to_numpy() for c in ("component", "lo", "hi")]
    node, shingles = got.column("node").to_numpy(), got.column("shingles")
    order = np.lexsort((node, *columns[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    for group in np.split(order, np.flatnonzero(new)[1:]):
        links = spanning([np.frombuffer(shingles[int(k)].as_py(), np.uint64) for k in group], share) if len(group) > 1 else []
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(node[group[a]]), pa.array(node[group[b]])], names=["a", "b"])


def near_fingerprints(found: DataFrame) -> DataFrame:
    """(node, least): each node and the least of those whose fingerprints its own reaches by steps of at most DISTANCE bits."""
    least = written(found.groupBy("fp").agg(F.min("node").alias("least")))
    reached = components(links(least, DISTANCE))
    leader = least.join(reached.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    led = leader.groupBy("component").agg(F.min("least").alias("leader"))
    named = leader.join(led, "component").select("fp", "leader")
    return found.select("node", "fp").distinct().join(named, "fp").where("node <> leader").select("node", F.col("leader").alias("least"))


def candidates(found: DataFrame) -> DataFrame:
    """(id, component) of the nodes that share a band with another or have near fingerprints; rows (node, fp, keys) may repeat a node."""
    keyed = found.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    pairs = keyed.join(shared, "key").where("node <> least").select("node", "least").unionByName(near_fingerprints(found))
    # A node keeps a link to the smallest of its bands' least nodes; the others of them link to that one, which connects the same.
    led = pairs.groupBy("node").agg(F.collect_set("least").alias("all")).withColumn("least", F.array_min("all"))
    ends = F.explode(F.concat(F.array("node"), F.array_remove("all", F.col("least"))))
    return components(led.select(ends.alias("a"), F.col("least").alias("b")).distinct())


def verified(found: DataFrame, distinct: DataFrame, width: int, share: float) -> DataFrame:
    """(a, b) pairs of nodes that connect all that is connected by steps of at least `share`. Each node is a row of distinct, which
    names the row of found with its text."""
    spark = found.sparkSession
    near = candidates(found.select("node", "fp", "keys"))
    sizes = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sought = near.join(sizes, "component").join(distinct.select(F.col("node").alias("id"), "row"), "id").select("row", "component", "blocks", F.col("id").alias("node"))
    texts = found.select("row", F.col("doc.text").cast("binary").alias("text")).join(sought, "row").select("component", "blocks", "node", "text")
    members = written(texts.mapInArrow(lambda it: _sets(it, width), "component long, blocks int, node long, shingles binary"))
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "shingles")
    size = members.agg(F.sum(F.length("shingles") * F.col("blocks"))).first()[0] or 0
    return dealt.repartition(parts(spark, size, 32_000_000), "component", "lo", "hi").mapInArrow(lambda it: _compare(it, share), "a long, b long")


def grouped(docs: DataFrame, width: int = 5, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc, row, node) for each row of docs, doc being its columns as they were, and (node, component_id) for each node.

    component_id is the smallest doc_id reachable by steps of a Jaccard similarity of at least `share` between sets of `width`-word
    shingles; a shorter text is one shingle. Null and blank texts are one node that links to no other. Null doc_ids never name a
    component, so it is null where all are.
    """
    kind = docs.select(F.struct("*").alias("doc")).schema["doc"].dataType.simpleString()
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").cast("binary").alias("text"))
    found = written(rows.mapInArrow(lambda it: _nodes(it, width), f"doc {kind}, {NODE}"))
    distinct = written(found.groupBy("node").agg(F.min("doc.doc_id").alias("least"), F.min("row").alias("row")))
    linked = components(verified(found, distinct, width, share))
    named = distinct.join(linked.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.select("doc", "row", "node"), written(named.join(least, "component").select("node", "component_id"))
