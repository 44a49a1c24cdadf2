"""Evidence for entities and around blocks: what a summary may be made of, and a block with its context, projection and table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from . import currency, search
from .projections import projected
from .selection import latest

EVIDENCE = ["entity", "n", "kind", "source", "doc_id", "version_id", "extraction_id", "block_id", "projection_id", "page", "claim_id", "revision", "status", "run_id", "model_identity", "text"]


def _first(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n)


def entity_evidence(documents: DataFrame, versions: DataFrame, extractions: DataFrame, blocks: DataFrame, analyses: DataFrame, claims: DataFrame, stale: DataFrame, cited: DataFrame, heads: DataFrame, projections: DataFrame | None = None, allowed: DataFrame | None = None, hold: bool = False, docs: int = 10, blocks_a_doc: int = 6, most_analyses: int = 10, most_claims: int = 50, block_order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The numbered evidence of each entity (EVIDENCE): blocks of its newest documents, finished analyses of them, and its current claims.

    documents: entity, source, doc_id; versions: source, doc_id, version_id, synced_at, is_current; extractions: source, doc_id, version_id, extraction_id, ingest_seq; blocks: extraction_id, ordinal, block_id, page, text;
    analyses: run_id, source, doc_id, version_id, model_identity, status, draft, finished_at; claims: entity, claim_id, revision, statement, status, evidence, counterevidence, updated_at; stale: kind, object_id (of a claim `id@revision`);
    cited and heads as in currency.current_evidence; allowed: source, doc_id. The newest documents are taken first and those outside `allowed` then left out; of a document's first blocks with text (in the order of block_order, columns of blocks), those
    that pass the gate; stale analyses and claims, and claims whose evidence is no longer current, are left out. Order: documents by synced_at, then analyses, then claims.
    """
    key = ["source", "doc_id"]
    current = versions.where("is_current").select(*key, "version_id", "synced_at")
    newest = _first(documents.select("entity", *key).distinct().join(current, key), ["entity"], docs, F.desc("synced_at"), *key).withColumnRenamed("_k", "d")
    if allowed is not None:
        newest = newest.join(allowed.select(*key).distinct(), key, "left_semi")
    read = latest(extractions.join(newest.select(*key, "version_id").distinct(), [*key, "version_id"], "left_semi"), [*key, "version_id"], F.desc("ingest_seq")).select(*key, "version_id", "extraction_id")
    shown = _first(blocks.join(read.select("extraction_id"), "extraction_id", "left_semi").where(F.col("text").rlike(r"(?U)\S")), ["extraction_id"], blocks_a_doc, *block_order).withColumnRenamed("_k", "nth")
    gated = search.gate(shown, projections, heads if projections is not None else None, hold)
    of_blocks = newest.join(read, [*key, "version_id"]).join(gated, "extraction_id").select("entity", F.lit(0).alias("part"), F.col("d").cast("long").alias("a"), F.col("ordinal").cast("long").alias("b"), "nth", F.lit("document_block").alias("kind"), *key, "version_id", "extraction_id", "block_id", "projection_id", "page", "text")
    live = analyses.where("status = 'done' AND draft IS NOT NULL").join(stale.where("kind = 'analysis'").select(F.col("object_id").alias("run_id")), "run_id", "left_anti")
    runs = _first(newest.select("entity", *key, "version_id").join(live, [*key, "version_id"]), ["entity"], most_analyses, F.desc("finished_at"), F.col("run_id"))
    of_runs = runs.select("entity", F.lit(1).alias("part"), F.col("_k").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("analysis").alias("kind"), *key, "version_id", "run_id", "model_identity", F.col("draft").alias("text"))
    latest_claims = _first(claims, ["entity"], most_claims, F.desc("updated_at"), F.col("claim_id"))
    name = F.concat_ws("@", F.col("claim_id").cast("string"), F.col("revision").cast("string"))
    fresh = latest_claims.withColumn("_name", name).join(stale.where("kind = 'claim'").select(F.col("object_id").alias("_name")), "_name", "left_anti")
    both = F.concat(F.lit("["), F.coalesce("evidence", F.lit("[]")), F.lit(","), F.coalesce("counterevidence", F.lit("[]")), F.lit("]"))
    valid = currency.current_evidence(fresh.select(F.col("_name").alias("object"), both.alias("evidence")), cited, heads, hold).where("current").select(F.col("object").alias("_name"))
    of_claims = fresh.join(valid, "_name", "left_semi").select("entity", F.lit(2).alias("part"), F.col("_k").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("claim_id"), "revision", "status", F.col("statement").alias("text"))
    every = of_blocks.unionByName(of_runs, allowMissingColumns=True).unionByName(of_claims, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy("entity").orderBy("part", "a", "b", "nth"))
    return every.withColumn("n", number.cast("long")).select(*EVIDENCE)


def evidence_context(wanted: DataFrame, blocks: DataFrame, projections: DataFrame, heads: DataFrame, hold: bool = False) -> DataFrame:
    """block_id, text, shown, projection_id, selection, before, after, table, cells, error of wanted blocks (block_id, projection_id: null for what is current).

    blocks: block_id, extraction_id, ordinal, text, table (array of rows of cells, or null), header_rows. Without a projection asked for, `text` and the neighbours are raw and `shown` is the current
    projection; with one, all are as it shows them, and neighbours that consumers may not see are left out. One that is not the block's, or of another text, is an error, and then there is
    no text. `cells` has each cell's row, column, whether it is a header's, and the number that it reads as.
    """
    none = F.lit(None).cast("string")
    kinds = [
        wanted.select("block_id", F.lit("asked").alias("kind"), "projection_id", none.alias("sha"), none.alias("text")),
        heads.select("block_id", F.lit("head").alias("kind"), "projection_id", none.alias("sha"), none.alias("text")),
        projections.select("block_id", F.lit("stored").alias("kind"), "projection_id", F.col("text_sha256").alias("sha"), F.col("projected_text").alias("text")),
    ]
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    # What is asked of a block, its head, and its projections meet its text once; one of another block is as good as none.
    side = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).repartition("block_id").groupBy("block_id").agg(F.collect_list(of("asked", F.struct(F.col("projection_id").alias("asked")))).alias("asks"), F.max(of("head", F.col("projection_id"))).alias("head"), F.collect_list(of("stored", F.struct("projection_id", "sha", "text"))).alias("stored"))
    own = lambda chosen: F.get(F.filter("stored", lambda x: x["projection_id"] == chosen), F.lit(0))
    base = blocks.select("block_id", "extraction_id", "ordinal", "text", "table", "header_rows").join(side, "block_id", "left").withColumn("_p", own(F.col("head")))
    text, error, projection = projected(F.col("text"), F.col("head"), F.col("_p"), F.col("_p").isNotNull())
    fit = error.isNull() & search.admitted(text, projection, hold)
    # As a neighbour a block is its own text, its projection, or left out; texts then meet by extraction.
    near = base.withColumn("_raw", fit & projection.isNull()).withColumn("_shown", F.when(fit & projection.isNotNull(), text)).drop("_p")
    w = Window.partitionBy("extraction_id").orderBy("ordinal")
    view = F.struct("text", F.coalesce("_shown", F.when(F.col("_raw"), F.col("text"))).alias("gated"))
    around = near.select("block_id", "text", "table", "header_rows", "asks", "head", "stored", F.lag(view).over(w).alias("b"), F.lead(view).over(w).alias("a")).where("asks IS NOT NULL")
    asked = around.select("*", F.inline("asks")).withColumn("_chosen", F.coalesce("asked", "head")).withColumn("_p", own(F.col("_chosen")))
    text, error, projection = projected(F.col("text"), F.col("_chosen"), F.col("_p"), F.col("_p").isNotNull())
    joined = asked.withColumns({"error": error, "shown": text, "projection_id": projection})
    explicit = F.col("asked").isNotNull()
    cell = lambda r, row: F.transform(row, lambda v, c: F.struct(r.alias("row"), c.alias("column"), (r < F.coalesce(F.col("header_rows"), F.lit(0))).alias("is_header"), v.alias("text"), numbers.number_of(v)["value"].alias("value")))
    cells = F.flatten(F.transform("table", lambda row, r: cell(r, row)))
    return joined.select("block_id", F.when(explicit, F.col("shown")).when(F.col("error").isNull(), F.col("text")).alias("text"), "shown", "projection_id", F.when(explicit, "explicit").otherwise("current").alias("selection"), F.when(explicit, F.col("b.gated")).otherwise(F.col("b.text")).alias("before"), F.when(explicit, F.col("a.gated")).otherwise(F.col("a.text")).alias("after"), "table", cells.alias("cells"), "error")
