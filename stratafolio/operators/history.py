"""Reconciliation and history: snapshot diff, change ledger, version upsert, claims, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stable fields of a document, whose changes are semantic.
STABLE_FIELDS = ("title", "display_title", "summary", "author", "market", "symbol", "doc_type", "language", "report_period", "filing_date", "published_at", "report_date", "status", "source_url")
INHERITED_BASES = ("published_at", "filing_date")


def known(value: Column) -> Column:
    """Empty text counts as unknown."""
    return F.nullif(value.cast("string"), F.lit(""))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (new, absent, changed, same), fields: the changed ones, comma separated. An empty after snapshot marks nothing absent."""
    a = before.select(*keys, F.struct(*fields).alias("old"))
    b = after.select(*keys, F.struct(*fields).alias("new"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~known(F.col(f"old.{f}")).eqNullSafe(known(F.col(f"new.{f}"))), F.lit(f)) for f in fields)))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "absent").when(F.size(changed) > 0, "changed").otherwise("same")
    out = both.select(*keys, change.alias("change"), F.when(change == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))
    return out.where("change <> 'absent'") if after.isEmpty() else out


def reconciled_versions(persisted: DataFrame, observed: DataFrame) -> DataFrame:
    """(doc_id, version_id, sha256, state, is_current) after a snapshot.

    persisted: doc_id, version_id, sha256; observed: doc_id, version_id, sha256, declared, present, current. What was persisted never changes; a
    missing file is missing whatever else it is; a hash that differs from the persisted or declared one is a conflict; a document has one
    current version or none.
    """
    both = observed.join(persisted.select("doc_id", "version_id", F.col("sha256").alias("kept")), ["doc_id", "version_id"], "left")
    sha = F.coalesce("kept", "sha256")
    conflict = (F.col("sha256") != sha) | (F.col("declared") != sha)
    state = F.when(~F.col("present"), "missing").when(F.coalesce(conflict, F.lit(False)), "conflict").otherwise("ready")
    rated = both.select("doc_id", "version_id", sha.alias("sha256"), state.alias("state"), "current")
    one = rated.where("current").groupBy("doc_id").agg(F.count("*").alias("currents"))
    return rated.join(one, "doc_id", "left").select("doc_id", "version_id", "sha256", "state", (F.col("current") & (F.col("currents") == 1)).alias("is_current"))


def change_events(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, kind, detail) of one reconciliation, an event a row.

    documents: doc_id, known_before, changed_fields, was_available, available, old_current, new_current; versions: doc_id, version_id, is_new, state,
    old_state. One conflict event a document at most.
    """
    per = versions.groupBy("doc_id").agg(
        F.count_if("is_new").alias("new_versions"),
        F.min(F.when((F.col("state") == "conflict") & ~F.col("old_state").eqNullSafe(F.lit("conflict")), F.col("version_id"))).alias("conflict"),
    )
    d = documents.join(per, "doc_id", "left")
    event = lambda on, kind, detail: F.when(on, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))
    c = F.col
    events = F.array_compact(
        F.array(
            event(c("known_before") & (c("changed_fields") != ""), "metadata_updated", c("changed_fields")),
            event(c("new_versions") > 0, "new_version", c("new_versions")),
            event(c("old_current").isNotNull() & c("new_current").isNotNull() & (c("old_current") != c("new_current")), "current_changed", F.concat_ws(">", "old_current", "new_current")),
            event(c("known_before") & c("was_available") & ~c("available"), "became_unavailable", F.lit("")),
            event(c("known_before") & ~c("was_available") & c("available"), "recovered", F.lit("")),
            event(c("conflict").isNotNull(), "content_conflict", c("conflict")),
        )
    )
    return d.select("doc_id", F.explode(events).alias("e")).select("doc_id", "e.kind", "e.detail")


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Existing rows replaced by incoming ones of the same keys, except for the columns that keep their first value."""
    fields = [c for c in existing.columns if c not in keys]
    both = existing.select(*keys, F.struct(*fields).alias("a")).join(incoming.select(*keys, F.struct(*fields).alias("b")), keys, "full_outer")
    pick = lambda f: F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}")) if f in kept else F.when(F.col("b").isNotNull(), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    return both.select(*keys, *(pick(f).alias(f) for f in fields))


def public_time(explicit_at: Column, explicit_basis: Column, published: Column, filed: Column, first_observed: Column) -> Column:
    """(at, basis): a version's own evidence, else a document date that is not older than the version's first observation, else unknown."""
    fits = lambda day: F.coalesce(day >= first_observed, F.lit(False))
    own = explicit_at.isNotNull()
    at = F.when(own, explicit_at).when(fits(published), published).when(fits(filed), filed)
    basis = F.when(own, explicit_basis).when(fits(published), "published_at").when(fits(filed), "filing_date").otherwise("unknown")
    return F.struct(at.alias("at"), basis.alias("basis"))


def misbound_public_times(versions: DataFrame) -> DataFrame:
    """Versions whose public time was inherited from the document though it is older than their first observation, or that is unknown."""
    return versions.where(F.col("public_available_at").isNotNull() & F.col("public_time_basis").isin(*INHERITED_BASES) & (F.col("first_observed_at").isNull() | (F.col("public_available_at") < F.col("first_observed_at"))))


# The status that each review action leads to.
ACTIONS = {"accept": "accepted", "reject": "rejected", "challenge": "challenged", "revise": "proposed", "supersede": "superseded"}


def claim_states(revisions: DataFrame) -> DataFrame:
    """(claim_id, revision, status): the newest of revisions (claim_id, revision, action); an unknown action leaves it proposed."""
    newest = revisions.groupBy("claim_id").agg(F.max(F.struct("revision", "action")).alias("r"))
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("r.action")), F.lit("proposed"))
    return newest.select("claim_id", "r.revision", status.alias("status"))


def entities(documents: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """(doc_id, entity_type, entity_id) of documents (doc_id, symbol, title): the company of the symbol, topics whose keyword is in the title."""
    company = F.when(F.trim("symbol") != "", F.struct(F.lit("company").alias("entity_type"), F.upper(F.trim("symbol")).alias("entity_id")))
    matched = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("title"), w)), F.struct(F.lit("topic").alias("entity_type"), F.lit(topic).alias("entity_id"))) for topic, words in topics.items() if words]
    return documents.select("doc_id", F.explode(F.array_distinct(F.array_compact(F.array(company, *matched)))).alias("e")).select("doc_id", "e.*")
