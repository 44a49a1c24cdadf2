"""Currency of what was derived: what a change makes stale through any number of steps, and whether nested evidence still holds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written

# Why an object became stale, in one step and in several.
CHANGED, DEPENDENCY = "chart_content_changed", "chart_dependency_changed"


def stale(references: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, hops, reason): everything that depends on what changed, with the least number of steps.

    references: id, cites (an object and what it is derived from); changed: id. Each round follows only the objects found in the
    round before (semi-naive), drops what is known, and is written to the shared folder; so rounds are as many as the longest shortest chain, and cycles end. A
    changed object that depends on another is stale itself. Null ids depend on nothing; rows that repeat change nothing.
    """
    edges = written(references.select("id", "cites").where("id IS NOT NULL AND cites IS NOT NULL").distinct())
    frontier = written(changed.select(F.col("id").alias("cites")).where("cites IS NOT NULL").distinct())
    rounds, hops = [], 0
    known = None
    while True:
        hops += 1
        reached = edges.join(frontier, "cites").select("id").distinct()
        new = reached if known is None else reached.join(known, "id", "left_anti")
        found = written(new.withColumn("hops", F.lit(hops)))
        dropped(frontier)
        if found.isEmpty():
            break
        rounds.append(found)
        known = rounds[0].select("id")
        for r in rounds[1:]:
            known = known.unionByName(r.select("id"))
        if len(rounds) % 16 == 0:  # what is known is read in few files however many rounds there are
            whole = rounds[0]
            for r in rounds[1:]:
                whole = whole.unionByName(r)
            whole = written(whole)
            dropped(*rounds[:-1])
            rounds, known = [whole], whole.select("id")
        frontier = written(found.select(F.col("id").alias("cites")))
    dropped(edges)
    out = found if not rounds else rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.withColumn("reason", F.when(F.col("hops") == 1, CHANGED).otherwise(DEPENDENCY))


NODE = "object string, block_id string, projection_id string, extraction_id string, source string, doc_id string, version_id string"
_KEYS = ["block_id", "projection_id", "extraction_id", "source", "doc_id", "version_id"]


#: Nodes that are handed on at once.
NODES = 10_000


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every JSON object, at any depth, that names a block, an extraction or a document. Held are the JSON of one object and NODES of what was found."""
    out: list[tuple] = []

    def taken() -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * (1 + len(_KEYS))
        found = pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["object", *_KEYS])
        out.clear()
        return found

    for batch in batches:
        for k in range(batch.num_rows):
            name, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            try:
                stack = [json.loads(text)] if text is not None else []
            except ValueError:
                stack = []
            while stack:
                v = stack.pop()
                if isinstance(v, dict):
                    if v.get("block_id") or v.get("extraction_id") or (v.get("source") and v.get("doc_id")):
                        out.append((name, *(None if v.get(k) is None else str(v[k]) for k in _KEYS)))
                    stack += v.values()
                elif isinstance(v, list):
                    stack += v
                if len(out) >= NODES:
                    yield taken()
        if out:
            yield taken()


def current_evidence(objects: DataFrame, blocks: DataFrame, heads: DataFrame, hold: bool = False) -> DataFrame:
    """(object, current) for each of objects (object, evidence as JSON): whether all that its evidence names, at any depth, is what is shown today.

    blocks: block_id, extraction_id, source, doc_id, version_id, risky (would be held for review); heads: block_id, projection_id. A block must be cited
    with its head's projection, or without one where it has none; while candidates are held, a risky block cited without a projection is not
    current. A coarse reference (an extraction, a document, a version of one) can't prove which blocks it means, so it fails as soon as one of them has a head or is
    held. Evidence that names nothing, is null or no JSON is current.
    """
    named = objects.select(F.col("object").cast("string").alias("object"), F.col("evidence").cast("string").alias("evidence"))
    nodes = written(named.mapInArrow(_nodes, NODE))
    shown = blocks.select("block_id", "extraction_id", "source", "doc_id", "version_id", "risky").join(heads.select("block_id", F.col("projection_id").alias("head")), "block_id", "left")
    held = F.lit(hold) & F.coalesce("risky", F.lit(False))
    exact = nodes.where("block_id > ''").join(heads.select("block_id", F.col("projection_id").alias("head")), "block_id", "left").join(blocks.select("block_id", "risky"), "block_id", "left")
    bad = exact.where(~F.col("projection_id").eqNullSafe(F.col("head")) | (F.coalesce("projection_id", F.lit("")) == "") & held).select("object")
    unsafe = written(shown.where(F.col("head").isNotNull() | held).select(*(F.col(c).cast("string").alias(c) for c in _KEYS[2:])))
    coarse = nodes.where("coalesce(block_id, '') = ''")
    by_extraction = coarse.where("extraction_id > ''").select("object", "extraction_id").join(unsafe.select("extraction_id").distinct(), "extraction_id", "left_semi")
    by_version = coarse.where("coalesce(extraction_id, '') = '' AND version_id > ''").select("object", *_KEYS[3:]).join(unsafe.select(*_KEYS[3:]).distinct(), _KEYS[3:], "left_semi")
    by_document = coarse.where("coalesce(extraction_id, '') = '' AND coalesce(version_id, '') = ''").select("object", "source", "doc_id").join(unsafe.select("source", "doc_id").distinct(), ["source", "doc_id"], "left_semi")
    failed = bad.unionByName(by_extraction.select("object")).unionByName(by_version.select("object")).unionByName(by_document.select("object")).distinct().withColumn("current", F.lit(False))
    return named.select("object").distinct().join(failed, "object", "left").select("object", F.coalesce("current", F.lit(True)).alias("current"))


def invalidated(changes: DataFrame, blocks: DataFrame, objects: DataFrame, references: DataFrame) -> DataFrame:
    """(kind, object_id, hops, reason) of what changes of blocks make stale, in one set-based step.

    changes: block_id; blocks: block_id, extraction_id; objects: kind, object_id, evidence (JSON) are those that cite blocks or extractions, directly and at any
    depth; references: kind, object_id, cited_kind, cited_id say which objects are derived from which. An object citing a block or the extraction of
    one is stale, and so is all that is derived from it.
    """
    node = lambda kind, name: F.to_json(F.array(F.col(kind).cast("string"), F.col(name).cast("string")))
    touched = changes.select("block_id").distinct().join(blocks.select("block_id", "extraction_id"), "block_id", "left")
    hit = touched.select(F.explode(F.array_compact(F.array(F.concat(F.lit("b:"), "block_id"), F.concat(F.lit("e:"), "extraction_id")))).alias("id")).distinct()
    cited = objects.select(node("kind", "object_id").alias("object"), "evidence").mapInArrow(_nodes, NODE)
    direct = cited.select(F.col("object").alias("id"), F.explode(F.array_compact(F.array(F.concat(F.lit("b:"), "block_id"), F.concat(F.lit("e:"), "extraction_id")))).alias("cites"))
    derived = references.select(node("kind", "object_id").alias("id"), node("cited_kind", "cited_id").alias("cites"))
    found = stale(direct.unionByName(derived), hit)
    pair = F.from_json("id", "array<string>")
    return found.select(F.get(pair, F.lit(0)).alias("kind"), F.get(pair, F.lit(1)).alias("object_id"), "hops", "reason")
