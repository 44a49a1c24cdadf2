"""Reports over the stores: the directory of documents, the state of operations, classes of pages, claims that cite a document, summaries to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content, quality
from .selection import latest_by

# Recorded issues that count as damage of a page.
RECORDED = ("control_characters", "c1_or_del_characters", "cid_style_glyph_runs", "damaged_text_layer")


def directory(documents: DataFrame, versions: DataFrame, flags: Column, order: list[Column], limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of documents (key, and their own columns, already filtered) with version_count, current_version_id and flags, in a total order, and the number of all. limit is held to 1 to 100,
    the window to 1000. Versions (key, version_id, is_current) are counted only for the page's documents."""
    limit = max(1, min(limit, 100))
    if offset < 0 or offset + limit > 1000:
        raise ValueError("outside the result window")
    page = documents.withColumn("flags", flags).orderBy(*order).offset(offset).limit(limit)
    own = versions.join(F.broadcast(page.select("key")), "key", "left_semi")  # `limit` rows
    counted = own.groupBy("key").agg(F.count("*").alias("version_count"), F.max(F.when(F.col("is_current"), F.col("version_id"))).alias("current_version_id"))
    return page.join(F.broadcast(counted), "key", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0))), documents.count()


def operations(jobs: DataFrame, outboxes: DataFrame, generation: str | None, now: Column, hours: int = 24) -> DataFrame:
    """(part, name, n) of one report: jobs by stage and status (jobs: stage, status, updated_at), those that failed in the last hours, outbox entries by box and status (outboxes: box, status), and the active
    generation (1, or 0 where there is none)."""
    by_status = jobs.groupBy(F.concat_ws("/", "stage", "status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("jobs").alias("part"), "name", "n")
    recent = (F.col("status") == "failed") & (F.col("updated_at") >= now - F.make_interval(hours=F.lit(hours))) & (F.col("updated_at") <= now)
    failed = jobs.agg(F.count_if(recent).alias("n")).select(F.lit("failed").alias("part"), F.lit(f"{hours}h").alias("name"), "n")
    boxes = outboxes.groupBy(F.concat_ws("/", "box", "status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("outbox").alias("part"), "name", "n")
    active = jobs.sparkSession.createDataFrame([("generation", generation or "none", int(generation is not None))], "part string, name string, n long")
    return by_status.unionByName(failed).unionByName(boxes).unionByName(active)


def page_classes(blocks: DataFrame, statuses: DataFrame, key: str = "extraction_id") -> DataFrame:
    """key, page, chars, damage, recorded_status of the pages of blocks (key, page, text, issues): characters in all, what is damaged in any block or was recorded so, and the state at
    the page's place in statuses (key, page_ocr_status); null where that is shorter. A block without a page counts for the first."""
    page = F.when(F.coalesce("page", F.lit(0)) < 1, 1).otherwise(F.col("page"))
    recorded = F.filter(F.coalesce("issues", F.array().cast("array<string>")), lambda i: i.isin(*RECORDED))
    seen = blocks.select(key, page.alias("page"), F.length(F.coalesce("text", F.lit(""))).alias("n"), F.array_union(quality.damage_tags(F.coalesce("text", F.lit(""))), recorded).alias("d"))
    per = seen.groupBy(key, "page").agg(F.sum("n").alias("chars"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("d")))).alias("damage"))  # at most as many sets as there are kinds of damage
    return per.join(statuses.select(key, "page_ocr_status"), key, "left").select(key, "page", "chars", "damage", F.get("page_ocr_status", F.col("page") - 1).alias("recorded_status"))


def claims_citing(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """claim_id, doc_id of claims (claim_id, evidence as JSON) that cite one of documents (doc_id) at any depth: each value is parsed once, and its references meet the documents by equality."""
    cited = claims.select("claim_id", F.explode(content.json_references(F.col("evidence"), ("doc_id",))).alias("r")).select("claim_id", F.col("r.id").alias("doc_id"))
    return cited.join(documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi").select("claim_id", "doc_id")


def unpublished(summaries: DataFrame, log: DataFrame) -> DataFrame:
    """entity, revision: the newest revision of each entity of summaries (entity, revision) that its log (entity, revision) lacks."""
    newest = latest_by(summaries.select("entity", "revision"), ["entity"], ["revision"])
    return newest.join(log.select("entity", "revision"), ["entity", "revision"], "left_anti")
