"""What may happen to the files of a reading folder, and which blocks wait for a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality

# The dispositions, and the owners whose files a machine made.
KEEP, CONFLICT, UNKNOWN, ARCHIVE = "keep", "conflict-human-edit", "unknown-owner", "archive-candidate"
GENERATORS = ("reading-publisher", "existing-text-export")


def file_dispositions(files: DataFrame, manifest: DataFrame, current: DataFrame, linked: DataFrame, referenced: DataFrame, published: DataFrame, derived: tuple[str, ...] = ()) -> DataFrame:
    """(name, disposition, reason) of each of files (name, sha256): a plan, nothing is moved. The first rule that fits decides.

    manifest: name, owner, last_hash as the machine last wrote it; the others are names: of current entries, linked from the current index, referenced by a human's note anywhere, of consumed publish
    events. A file that a human edited is in conflict; what a reader, the index or an event still leads to is kept; without a record the owner is unknown; what a generator made and nothing leads to
    may be archived. Names that repeat on a side count once.
    """
    flag = lambda df, name: df.select("name").distinct().withColumn(name, F.lit(True))
    known = manifest.select("name", F.struct("owner", "last_hash").alias("m")).dropDuplicates(["name"])
    seen = files.select("name", "sha256").join(known, "name", "left")
    for df, name in ((current, "_current"), (linked, "_linked"), (referenced, "_referenced"), (published, "_published")):
        seen = seen.join(flag(df, name), "name", "left")
    rules = [
        (F.col("m.last_hash").isNotNull() & (F.col("m.last_hash") != F.col("sha256")), CONFLICT, "edited by a human"),
        (F.col("_referenced").isNotNull(), KEEP, "referenced by a human's note"),
        (F.col("_current").isNotNull() | F.col("_linked").isNotNull() | F.col("name").isin(*derived), KEEP, "the current entry, or linked from the index"),
        (F.col("_published").isNotNull(), KEEP, "a delivered revision"),
        (F.col("m").isNull(), UNKNOWN, "no record of an owner"),
        (F.coalesce(F.col("m.owner").isin(*GENERATORS), F.lit(False)), ARCHIVE, "machine-made, and nothing leads to it"),
    ]
    chosen = F.struct(F.lit(KEEP).alias("d"), F.lit("its owner is no generator").alias("r"))
    for fits, disposition, reason in reversed(rules):
        chosen = F.when(fits, F.struct(F.lit(disposition).alias("d"), F.lit(reason).alias("r"))).otherwise(chosen)
    return seen.select("name", chosen.alias("c")).select("name", F.col("c.d").alias("disposition"), F.col("c.r").alias("reason"))


def disposition_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("disposition").agg(F.count("*").alias("n"))


def review_queue(blocks: DataFrame, queue: DataFrame, limit: int = 500) -> DataFrame:
    """block_id, text_sha256, kind, status of the first `limit` (1 to 5000) blocks (block_id, seq, text) by seq that the queue (block_id) lacks: pending where a chart or table may have been taken
    for text, else not_flagged. A second scan goes on behind the first; nothing is removed by a guess."""
    new = blocks.join(queue.select("block_id"), "block_id", "left_anti").orderBy("seq", "block_id").limit(max(1, min(limit, 5000)))
    signal = quality.chart_signal(F.col("text"), quality.stripped_lines(F.col("text")))
    rated = new.select("block_id", F.sha2("text", 256).alias("text_sha256"), signal.alias("s"))
    return rated.select("block_id", "text_sha256", F.col("s.kind").alias("kind"), F.when(F.coalesce("s.requires_review", F.lit(False)), "pending").otherwise("not_flagged").alias("status"))
