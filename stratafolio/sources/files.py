"""Byte-level sources and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshots(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, sha256, content) of files under a path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def blobs(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each content that isn't stored yet: sha256, length, content."""
    new = files if existing is None else files.join(existing.select("sha256"), "sha256", "left_anti")
    return new.select("sha256", "length", "content").dropDuplicates(["sha256"])


def broken_blobs(stored: DataFrame) -> DataFrame:
    """Stored blobs whose content no longer has their hash."""
    return stored.where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def read_archive(spark: SparkSession, manifest: str, artifacts: str) -> DataFrame:
    """Reports with their artifacts: state missing, conflict or ready; available only with a unique ready current artifact."""
    m, a = spark.read.parquet(manifest), spark.read.parquet(artifacts).where("state = 'ready'")
    per = a.groupBy("report_id").agg(F.collect_list(F.struct("artifact_id", "sha256", "bytes", "media_type")).alias("artifacts"))
    d = m.join(per, "report_id", "left").withColumn("current", F.filter(F.coalesce("artifacts", F.array().cast("array<struct<artifact_id:string,sha256:string,bytes:bigint,media_type:string>>")), lambda x: x["artifact_id"] == F.col("current_artifact_id")))
    state = F.when(F.col("artifacts").isNull(), "missing").when(F.size("current") > 1, "conflict").otherwise("ready")
    return d.select("*", state.alias("archive_state"), ((F.col("status") == "done") & (F.size("current") == 1)).alias("available"))


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line or a missing or repeated doc_id is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"doc_id missing or repeated: {bad[0].doc_id}")
    return rows


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One ordered export with \\n line ends; range-partitioned files in order."""
    df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", "\"").option("emptyValue", "").csv(path)


def markdown_cards(docs: DataFrame, title: str, body: str, key: str) -> DataFrame:
    """(path, content, sha256): a card for each document; a sink writes those whose hash changed."""
    from ..functions.text import markdown_text, safe_filename, yaml_scalar

    content = F.concat(F.lit("---\ntitle: "), yaml_scalar(F.col(title)), F.lit("\n---\n\n# "), markdown_text(F.col(title)), F.lit("\n\n"), markdown_text(F.col(body), block=True), F.lit("\n"))
    cards = docs.select(F.concat(safe_filename(F.col(key).cast("string")), F.lit(".md")).alias("path"), content.alias("content"))
    return cards.withColumn("sha256", F.sha2("content", 256))


def changed_files(cards: DataFrame, written: DataFrame) -> DataFrame:
    """Cards not yet written with this hash, and what a sink must do: written, refreshed, or preserved_with_candidate where a human edited the file.

    written: path, sha256 (as last written by us), found (hash of the file now).
    """
    d = cards.join(written.select("path", F.col("sha256").alias("ours"), "found"), "path", "left")
    outcome = F.when(F.col("ours").isNull(), "written").when(F.col("found") != F.col("ours"), "preserved_with_candidate").when(F.col("ours") == F.col("sha256"), "unchanged").otherwise("refreshed")
    return d.select("path", "content", "sha256", outcome.alias("outcome"))
