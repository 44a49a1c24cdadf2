"""Search that never answers from what is no longer there: one gate for what consumers may see, generations bound to their source, and hits rechecked against
the present text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, quality
from ..functions.text import tokens
from . import index, retrieval, selection
from .projections import projected_blocks
from .storage import dropped, listing, written

#: Candidates that are rechecked for each hit that is wanted, at first; more follow where too few of them pass.
CANDIDATES_A_HIT = 2
#: Hits of a query at most.
MOST_HITS = 1000


def gate(blocks: DataFrame, projections: DataFrame | None = None, heads: DataFrame | None = None, hold: bool = False) -> DataFrame:
    """The blocks (block_id, text, and their own columns) that factual consumers may see, with the text they see and its projection_id.

    The authoritative text is projected by its head; what no longer fits its projection, isn't usable as evidence, or, while candidates are held,
    looks like a chart without having been projected, is left out. Without heads all blocks are raw.
    """
    if heads is None or projections is None:
        seen = blocks.withColumn("projection_id", F.lit(None).cast("string"))
    else:
        seen = projected_blocks(blocks, projections, heads).where("error IS NULL").drop("error", "raw_text_sha256")
    return seen.where(admitted(F.col("text"), F.col("projection_id"), hold))


def admitted(text: Column, projection_id: Column, hold: bool = False) -> Column:
    """Whether a text, of a projection or raw, may be shown as evidence."""
    good = quality.usable(text)
    if hold:
        risky = quality.chart_signal(text, quality.stripped_lines(text))["requires_review"]
        good = good & (projection_id.isNotNull() | ~F.coalesce(risky, F.lit(False)))
    return good


def selected_blocks(versions: DataFrame, extractions: DataFrame, blocks: DataFrame, projections: DataFrame | None = None, heads: DataFrame | None = None, hold: bool = False) -> DataFrame:
    """(doc_id, ordinal, block_id, text) to be indexed: of each current version (versions: version, doc_id, is_current) the blocks of its effective extraction
    that pass the gate. extractions and blocks are those of selection.effective_extractions, blocks with block_id and ordinal."""
    current = versions.where("is_current").select("version", "doc_id")
    effective = selection.effective_extractions(extractions.join(current.select("version"), "version", "left_semi"), blocks)
    own = blocks.join(effective.select("version", "extraction_id"), "extraction_id").join(current, "version")
    return gate(own.select("doc_id", "ordinal", "block_id", "text"), projections, heads, hold).select("doc_id", "ordinal", "block_id", "text")


def source_state(spark: SparkSession, *paths: str) -> str:
    """A digest of the files (names, sizes, times) of the tables that a generation is made of; changed tables have another. Only file names pass the driver."""
    import hashlib

    found = [x for p in paths for x in listing(spark, p)]
    return hashlib.sha256(repr(found).encode()).hexdigest()


def current_generation(store: index.IndexStore, blocks: DataFrame, source: str) -> tuple[str, bool]:
    """The generation of a source, and whether it was built now. While the state of the source is that of the active generation nothing is read; else the blocks'
    manifest decides, so that a change that leaves the blocks alone builds nothing."""
    pointer = store.pointer()
    if pointer and pointer.get("source") == source:
        return pointer["generation"], False
    return store.build(blocks, source=source)


def visible_blocks(blocks: DataFrame, versions: DataFrame, cutoff: Column, mode: str) -> DataFrame:
    """(block_id) of the blocks (block_id, doc_id) whose current version (versions: doc_id, first_observed_at, public_available_at) was visible at a cutoff:
    mode `system` by its first observation, `public` by the evidence of its publication. What is unknown is not visible in the past."""
    seen = versions.where(dates.visible_at(F.col("first_observed_at"), F.col("public_available_at"), cutoff, mode).isNotNull())
    return blocks.join(seen.select("doc_id").distinct(), "doc_id", "left_semi").select("block_id")


def search(store: index.IndexStore, generation: str, queries: DataFrame, authoritative: DataFrame, limit: int = 20, allowed: DataFrame | None = None, projections: DataFrame | None = None, heads: DataFrame | None = None, hold: bool = False) -> DataFrame:
    """(query_id, rank, block_id, score, matched, projection_id): the first `limit` (1 to 1000) hits of each of queries (query_id, term).

    Scores are BM25 over the whole generation; `allowed` (block_id) is applied before any candidate is taken. Candidates are taken in the order of
    score and block_id and rechecked: their present text (authoritative: block_id, text) must pass the gate and still have a term by which they were found; matched has
    those. Only candidates are rechecked; where too few pass, four times as many are taken for those queries alone, until each query has its hits or no candidate is left.
    Scores are ordered to nine places, below which they depend on the order of their sums, and shown to four, half to even.
    """
    limit = max(1, min(int(limit), MOST_HITS))
    taken, asked, done = CANDIDATES_A_HIT * limit, queries, None
    while True:
        few = [r.term for r in asked.select("term").distinct().limit(retrieval.FEW_TERMS_READ + 1).collect()]
        found = store.postings_of(few, generation) if len(few) <= retrieval.FEW_TERMS_READ else store.postings_with(asked, generation)
        head = written(retrieval.best(found, store.blocks(generation), asked, taken, 9, allowed, store.sizes(generation), terms=True))
        raw = authoritative.join(head.select("block_id").distinct(), "block_id", "left_semi")
        present = gate(raw.select("block_id", "text"), projections, heads, hold).select("block_id", "projection_id", tokens(F.col("text")).alias("now"))
        matched = F.array_sort(F.array_distinct(F.array_intersect("terms", "now")))
        passed = written(head.join(present, "block_id").select("query_id", "rank", "block_id", "score", matched.alias("matched"), "projection_id").where(F.size("matched") > 0))
        want = head.groupBy("query_id").count().where(F.col("count") >= taken)
        short = written(want.join(passed.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").where(F.coalesce("hits", F.lit(0)) < limit).select("query_id"))
        dropped(head)
        whole = passed.join(short, "query_id", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if short.isEmpty():
            break
        asked, taken = queries.join(short, "query_id", "left_semi"), 4 * taken
    out = retrieval.top(done.drop("rank"), ["query_id"], limit, F.desc("score"), F.asc("block_id"))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "block_id", numbers.half_even(F.col("score"), 4).alias("score"), "matched", "projection_id")
