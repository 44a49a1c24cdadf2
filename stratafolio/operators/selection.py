"""Picking rows: latest, as-of, effective extraction, neighbours, sections, stratified picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark limits each task to it before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The greatest row of each key by the columns `by`: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in by]
    return df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_top")).select(*keys, "_top.*")


def as_of(df: DataFrame, keys: list[str], instant: str, cutoff: Column, *ties: str) -> DataFrame:
    """The newest row of each key whose instant is known and not after the cutoff."""
    return latest_by(df.where(F.col(instant).isNotNull() & (F.col(instant) <= cutoff)), keys, [instant, *ties])


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, instant: str, tie: str) -> DataFrame:
    """Each left row with the newest right row not after its instant; left rows without one keep nulls.

    Both sides go through one window ordered by instant, so no pair of rows is built that isn't a result.
    """
    values = [c for c in right.columns if c not in keys]
    a = left.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_right", F.lit(None).cast(_type_of(right, values)))
    b = right.select(*keys, F.col(instant).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"), F.col(tie).alias("_tie")).where("_at IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *(F.col(f"_seen.{c}").alias(c) for c in values))


def _type_of(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def effective_extractions(extractions: DataFrame, blocks: DataFrame) -> DataFrame:
    """The extraction that a version is read by.

    extractions: version, extraction_id, status, pages, missing_pages, ingest_seq; blocks: extraction_id, text, page, block_status. The newest
    one that is ready and wholly usable, with every page present, wins; else the newest not failed with any usable block. Returns
    version, extraction_id, tier (0 whole, 1 fallback), is_newest.
    """
    shown = blocks.where(F.length(F.trim("text")) > 0).withColumn("usable", quality.usable(F.col("text")))
    in_range = F.col("page").isNotNull() & (F.col("page") >= 1)
    per = shown.groupBy("extraction_id").agg(
        F.bool_and("usable").alias("all_usable"),
        F.bool_or("usable").alias("any_usable"),
        F.bool_and(F.col("block_status") == "ready").alias("all_ready"),
        F.collect_set(F.when(in_range, F.col("page"))).alias("page_set"),
    )
    pages_met = (F.col("pages") <= 0) | (F.size(F.filter("page_set", lambda p: p <= F.col("pages"))) == F.col("pages"))
    whole = (F.col("status") == "ready") & F.col("all_usable") & F.col("all_ready") & (F.col("missing_pages") <= 0) & pages_met
    tier = F.when(F.coalesce(whole, F.lit(False)), 0).when((F.col("status") != "failed") & F.coalesce("any_usable", F.lit(False)), 1)
    rated = extractions.join(per, "extraction_id", "left").withColumn("tier", tier)
    rated = rated.withColumn("newest", F.max("ingest_seq").over(Window.partitionBy("version")))
    best = latest(rated.where("tier IS NOT NULL"), ["version"], F.col("tier"), F.desc("ingest_seq"))
    return best.select("version", "extraction_id", "tier", (F.col("ingest_seq") == F.col("newest")).alias("is_newest"))


def sections(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Consecutive chunks of `size` rows, numbered from 0."""
    return df.withColumn("section", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size).cast("int"))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def hash_ordered_pick(df: DataFrame, stratum: str, item: str, per_stratum: int) -> DataFrame:
    """The first items of each stratum in the order of a digest of their id: a stable sample without a random generator."""
    digest = F.sha2(F.col(item).cast("string"), 256)
    w = Window.partitionBy(stratum).orderBy(digest)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_stratum)


def stratum_quotas(sizes: list[tuple[str, int]], total: int, rows: int | None = None) -> dict[str, int]:
    """Of a sample of `total`: one item for each stratum while they last, the rest in proportion, largest first. Only the `total`
    largest strata matter; with fewer than all in `sizes`, `rows` counts the rows of all."""
    order = sorted(sizes, key=lambda s: (-s[1], s[0]))
    quota = {k: 1 for k, n in order[:total] if n > 0}
    left, all_rows = total - len(quota), rows or sum(n for _, n in order) or 1
    for k, n in order:
        if k in quota and left > 0:
            extra = min(left, n - 1, max(0, round(n / all_rows * total) - 1))
            quota[k] += extra
            left -= extra
    return quota
