"""Claims and what hangs on them: append-only revisions, frozen decisions, proposals from new versions, corrected times, events, refreshes, and background packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import currency, search
from .history import ACTIONS, misbound_public_times
from .queues import identity
from .sampling import numbered
from .selection import latest

# The first state of a claim, actions that carry content, why claims are proposed for review and times corrected, and what a reset time is.
PROPOSED, CONTENT = "proposed", ("revise", "supersede")
NEW_VERSION, MISBOUND, UNKNOWN = "new_source_version", "misbound_inherited_document_date_reset_to_unknown", "unknown"


def reviewed(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim_id, revision, statement, status, evidence, counterevidence, reviewer, supersedes_revision, error: all revisions of claims (claim_id, statement, evidence, counterevidence) after
    reviews (claim_id, sequence, action, reviewer, new_statement, new_evidence, new_counterevidence), and the reviews that were refused (revision null).

    Every action appends a revision; only revise and supersede may change what a claim says, and name the revision that they replace. An unknown action or claim is refused and leaves no revision.
    """
    known = reviews.join(claims.select("claim_id", F.lit(True).alias("known")), "claim_id", "left")
    error = F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action").when(F.col("known").isNull(), "claim not found")
    judged = known.withColumn("error", error)
    first = claims.select("claim_id", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("reviewer"), F.col("statement").alias("new_statement"), F.col("evidence").alias("new_evidence"), F.col("counterevidence").alias("new_counterevidence"))
    both = first.unionByName(judged.where("error IS NULL").select(*first.columns))
    w = Window.partitionBy("claim_id").orderBy(F.col("sequence").asc_nulls_first())
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = F.col("action").isNull() | F.col("action").isin(*CONTENT)
    said = lambda c: F.last(F.when(carries, c), ignorenulls=True).over(so_far)
    revision = F.row_number().over(w)
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("action")), F.lit(PROPOSED))
    made = both.select("claim_id", revision.alias("revision"), said(F.nullif(F.col("new_statement"), F.lit(""))).alias("statement"), status.alias("status"), said(F.col("new_evidence")).alias("evidence"), said(F.col("new_counterevidence")).alias("counterevidence"), "reviewer", F.when(F.col("action").isin(*CONTENT), revision - 1).alias("supersedes_revision"), F.lit(None).cast("string").alias("error"))
    refused = judged.where("error IS NOT NULL").select("claim_id", "reviewer", "error")
    return made.unionByName(refused, allowMissingColumns=True)


def frozen_decisions(decisions: DataFrame, revisions: DataFrame) -> DataFrame:
    """decision_id, claim_id, revision, statement, error of decisions (decision_id, refs: array of claim_id, revision): each reference bound to a revision, the newest where none is
    named, with what it said; later revisions change nothing that was frozen. A reference to no claim is an error."""
    refs = decisions.select("decision_id", F.explode("refs").alias("r")).select("decision_id", "r.claim_id", F.col("r.revision").cast("int").alias("asked"))
    newest = revisions.groupBy("claim_id").agg(F.max("revision").alias("newest"))
    bound = refs.join(newest, "claim_id", "left").withColumn("revision", F.coalesce("asked", "newest"))
    said = bound.join(revisions.select("claim_id", "revision", "statement"), ["claim_id", "revision"], "left")
    return said.select("decision_id", "claim_id", "revision", "statement", F.when(F.col("newest").isNull(), "claim not found").alias("error"))


def proposals(versions: DataFrame, claims: DataFrame, existing: DataFrame) -> DataFrame:
    """proposal_id, event_id, claim_id, source, doc_id, version_id, affected_revision: the reviews that new versions (source, doc_id, version_id) propose of claims (claim_id, revision, evidence as
    JSON) that cite their document, at any depth, and that aren't in existing (proposal_id) yet. They never change a claim."""
    cited = claims.select(F.col("claim_id").cast("string").alias("object"), F.col("evidence").cast("string").alias("evidence")).mapInArrow(currency._nodes, currency.NODE)
    pairs = cited.where("source > '' AND doc_id > ''").select(F.col("object").alias("claim_id"), "source", "doc_id").distinct()
    hit = versions.selectExpr("CAST(source AS STRING) AS source", "CAST(doc_id AS STRING) AS doc_id", "CAST(version_id AS STRING) AS version_id").distinct().join(pairs, ["source", "doc_id"])
    named = hit.join(claims.select(F.col("claim_id").cast("string").alias("claim_id"), F.col("revision").alias("affected_revision")), "claim_id")
    found = named.withColumn("proposal_id", identity("rev-", 24, F.col("claim_id"), F.lit(NEW_VERSION), F.col("version_id"))).dropDuplicates(["proposal_id"])
    new = found.join(existing.select("proposal_id"), "proposal_id", "left_anti")
    return new.select("proposal_id", F.concat(F.lit("evt-"), "proposal_id").alias("event_id"), "claim_id", "source", "doc_id", "version_id", "affected_revision")


def resolved(proposals: DataFrame, answers: DataFrame) -> DataFrame:
    """proposal_id, status, error of answers (proposal_id, action) to proposals (proposal_id, status): dismiss and accept close an open one, once; the least action of several decides."""
    one = answers.groupBy("proposal_id").agg(F.min("action").alias("action"))
    seen = one.join(proposals.select("proposal_id", F.col("status").alias("was")), "proposal_id", "left")
    closed = F.when(F.col("action") == "dismiss", "dismissed").when(F.col("action") == "accept", "resolved")
    error = F.when(~F.coalesce(F.col("was") == "open", F.lit(False)), "proposal not found or not open").when(closed.isNull(), "action must be dismiss or accept")
    return seen.select("proposal_id", F.when(error.isNull(), closed).otherwise(F.col("was")).alias("status"), error.alias("error"))


def repaired_public_times(versions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions (source, doc_id, version_id, first_observed_at, public_available_at, public_time_basis, and more) with the times that were only inherited reset to unknown, and the corrections to append
    (source, doc_id, version_id, old_available_at, old_basis, new_basis, reason). What has its own evidence is left alone; what was corrected already is corrected no more; a second
    run finds nothing."""
    key = ["source", "doc_id", "version_id"]
    done = corrections.select(*key, F.col("old_available_at").alias("public_available_at"))
    new = misbound_public_times(versions).select(*key, "public_available_at", "public_time_basis").join(done, [*key, "public_available_at"], "left_anti").distinct()
    rows = new.select(*key, F.col("public_available_at").alias("old_available_at"), F.col("public_time_basis").alias("old_basis"), F.lit(UNKNOWN).alias("new_basis"), F.lit(MISBOUND).alias("reason"))
    marked = versions.join(new.select(*key, F.lit(True).alias("_reset")).distinct(), key, "left")
    reset = F.coalesce("_reset", F.lit(False))
    fixed = marked.withColumn("public_available_at", F.when(~reset, F.col("public_available_at"))).withColumn("public_time_basis", F.when(reset, UNKNOWN).otherwise(F.col("public_time_basis")))
    return fixed.select(*versions.columns), rows


def emitted(log: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """The events (event_id and more) to append to a log (event_id, sequence): each id once and only if the log lacks it, numbered on from the log's last sequence in the given order."""
    once = events.join(log.select("event_id"), "event_id", "left_anti").groupBy("event_id").agg(F.min(F.struct(*order, *(c for c in events.columns if c not in ("event_id", *order)))).alias("e")).select("event_id", "e.*")
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    placed = numbered(once.withColumn("_log", F.lit("")), "_log", [*order, "event_id"])
    return placed.withColumn("sequence", F.col("rank") + 1 + last).drop("_log", "rank")


def blocked_refreshes(summaries: DataFrame, outbox: DataFrame) -> DataFrame:
    """entity_type, entity_id, revision, event_key: entities whose newest blocked revision (summaries: entity_type, entity_id, revision, status) is queued anew, unless the outbox (event_key) has that very event."""
    rows = summaries.where("status = 'blocked'").groupBy("entity_type", "entity_id").agg(F.max("revision").alias("revision"))
    key = F.concat_ws(":", F.lit("refresh"), "entity_type", F.col("entity_id").cast("string"), F.col("revision").cast("string"))
    return rows.withColumn("event_key", key).join(outbox.select("event_key"), "event_key", "left_anti").select("entity_type", "entity_id", "revision", "event_key")


def reused(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """events (event_key, and more) with the newest done revision that already came of them, null where a provider must be asked: a crash between a result and its consumption costs no second call."""
    done = summaries.where("status = 'done' AND event_key IS NOT NULL").groupBy("event_key").agg(F.max("revision").alias("reused_revision"))
    return events.join(done, "event_key", "left")


def background_sources(documents: DataFrame, versions: DataFrame, extractions: DataFrame, blocks: DataFrame, cutoff: Column | None = None, mode: str = "system", limit: int = 50, projections: DataFrame | None = None, heads: DataFrame | None = None, hold: bool = False) -> DataFrame:
    """entity, rank, source, doc_id, version_id, extraction_id, refs (of ordinal, block_id, projection_id): the sources of each entity of documents (entity, source, doc_id, report_period).

    A document is shown by the version that a cutoff made visible last (ties: synced_at, then version_id), or by its current one without a cutoff, and is left out where none is
    provably visible; by the newest extraction (ingest_seq) made by the cutoff; and by those of its first three blocks that pass the consumers' gate. Filters come before the limit: unknown
    periods first, then the latest.
    """
    key = ["source", "doc_id"]
    if cutoff is None:
        chosen = latest(versions.where("is_current").join(documents.select(*key).distinct(), key, "left_semi"), key, F.desc("version_id"))
    else:
        instant = {"system": F.col("first_observed_at"), "public": F.col("public_available_at")}[mode]
        seen = versions.where(instant <= cutoff).withColumn("_at", instant)
        chosen = latest(seen, key, F.desc("_at"), F.coalesce("synced_at", "_at").desc(), F.desc("version_id"))
    made = extractions if cutoff is None else extractions.where(F.col("created_at") <= cutoff)
    newest = latest(made, [*key, "version_id"], F.desc("ingest_seq")).select(*key, "version_id", "extraction_id")
    shown = documents.select("entity", *key, "report_period").join(chosen.select(*key, "version_id"), key).join(newest, [*key, "version_id"], "left")
    order = Window.partitionBy("entity").orderBy(F.col("report_period").desc_nulls_first(), *key)
    first = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(limit, 200)))
    wanted = first.where("extraction_id IS NOT NULL").select("extraction_id").distinct().hint("shuffle_hash")  # few of all extractions, whose blocks then stream by unsorted
    heads_of = search.gate(blocks.where("ordinal < 3").join(wanted, "extraction_id", "left_semi").select("extraction_id", "ordinal", "block_id", "text"), projections, heads, hold)
    refs = heads_of.groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "projection_id"))).alias("refs"))  # three at most
    empty = F.array().cast(dict(refs.dtypes)["refs"])
    return first.join(refs, "extraction_id", "left").select("entity", F.col("rank").cast("long").alias("rank"), *key, "version_id", "extraction_id", F.coalesce("refs", empty).alias("refs"))


def background_claims(claims: DataFrame, revisions: DataFrame, versions: DataFrame, blocks: DataFrame, heads: DataFrame, stale: DataFrame | None = None, cutoff: Column | None = None, mode: str = "system", hold: bool = False) -> DataFrame:
    """entity, claim_id, revision, statement, status of the claims (claim_id, entity, created_at) as they stood at a cutoff: their newest revision (claim_id, revision, statement, status, evidence, counterevidence, created_at) by
    then. Left out are later claims, stale revisions (claim_id, revision), those whose evidence or counterevidence is no longer current, and, for mode public with a cutoff, those without evidence or with evidence of a version that
    wasn't provably public by then. blocks and heads are those of currency.current_evidence."""
    early = claims if cutoff is None else claims.where(F.col("created_at") <= cutoff)
    by_then = revisions if cutoff is None else revisions.where(F.col("created_at") <= cutoff)
    now = latest(by_then.join(early.select("claim_id"), "claim_id", "left_semi"), ["claim_id"], F.desc("revision"))
    if stale is not None:
        gone = stale.groupBy("claim_id").agg(F.collect_set("revision").alias("_gone"))  # by claim, as the rest is
        now = now.join(gone, "claim_id", "left").where(~F.coalesce(F.array_contains("_gone", F.col("revision")), F.lit(False))).drop("_gone")
    raw = F.concat(F.lit("["), F.coalesce("evidence", F.lit("[]")), F.lit(","), F.coalesce("counterevidence", F.lit("[]")), F.lit("]"))
    current = currency.current_evidence(now.select(F.col("claim_id").alias("object"), raw.alias("evidence")), blocks, heads, hold).where("current").select(F.col("object").alias("claim_id"))
    kept = now.withColumn("claim_id", F.col("claim_id").cast("string")).join(current, "claim_id", "left_semi")
    if cutoff is not None and mode == "public":
        ref = F.explode_outer(F.from_json("evidence", "array<struct<source:string,doc_id:string,version_id:string>>"))
        cited = kept.select("claim_id", ref.alias("r")).select("claim_id", "r.*")
        public = versions.selectExpr("CAST(source AS STRING) AS source", "CAST(doc_id AS STRING) AS doc_id", "CAST(version_id AS STRING) AS version_id", "public_available_at")
        shown = cited.join(public, ["source", "doc_id", "version_id"], "left").groupBy("claim_id").agg(F.bool_and(F.coalesce(F.col("public_available_at") <= cutoff, F.lit(False))).alias("all_public"))
        kept = kept.join(shown.where("all_public").select("claim_id"), "claim_id", "left_semi")
    owner = claims.select(F.col("claim_id").cast("string").alias("claim_id"), "entity")
    return kept.join(owner, "claim_id").select("entity", "claim_id", "revision", "statement", "status")
