"""Seeded and layered samples. A generator draws ranks on the driver, which sees the sizes of strata only; rows meet their rank by a join."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Rows of a range that are numbered by one task.
RANGE = 1_000_000


def quotas(sizes: list[tuple[str, int]], total: int, rows: int, strata: int) -> dict[str, int]:
    """Slots of a sample of `total`. sizes: the `total` largest strata at most, of all `strata` with `rows` rows. With too many strata the largest get one each; else each
    gets one, and what is left goes in proportion, the largest first (halves to even)."""
    order = sorted(sizes, key=lambda s: (-s[1], s[0]))
    if strata >= total:
        return {k: 1 for k, _ in order[:total]}
    out, left = {k: 1 for k, _ in order}, total - strata
    for k, n in order:
        extra = min(left, max(0, round(n / rows * total) - 1)) if left > 0 else 0
        out[k] += extra
        left -= extra
    return out


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `rank`, their place from 0 within their key in the given order: ranges of the whole order are numbered apart and begin where the ranges before them end, so
    that no key is one task's work. Rows that tie are in any order."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    ranged = written(rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))  # a row a range, and one more a key
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_in"), before.alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_place", place).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn("rank", F.col("_start") + F.col("_place")).drop("_range", "_key", "_in", "_start", "_place")


def seeded_sample(rows: DataFrame, stratum: str, order: list[str], total: int, tune: int, seed: int) -> DataFrame:
    """The sample that a Mersenne Twister of this seed draws from rows: its columns and `split` (tune or blind).

    Strata in the order of their names are sampled by their quotas from rows in the given order (which should be unique); the picks in that order then take
    shuffled marks, the first `tune` of which were tune. Only sizes of strata and `total` drawn ranks pass the driver. Empty rows give an empty sample; null strata are none.
    """
    spark = rows.sparkSession
    named = rows.where(F.col(stratum).isNotNull())
    counted = named.groupBy(stratum).agg(F.count("*").alias("n"))
    whole = counted.agg(F.count("*").alias("strata"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    sizes = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), stratum).limit(total).collect()}  # no more than `total` can have a slot
    slots, rng = quotas(list(sizes.items()), total, whole.rows, whole.strata), random.Random(seed)
    drawn = [(k, r) for k in sorted(slots) for r in rng.sample(range(sizes[k]), min(slots[k], sizes[k]))]
    marks = ["tune"] * min(tune, len(drawn)) + ["blind"] * max(0, len(drawn) - tune)
    rng.shuffle(marks)
    wanted = F.broadcast(spark.createDataFrame(drawn, "_stratum string, _rank long"))  # `total` rows at most
    own = named.join(F.broadcast(wanted.select(F.col("_stratum").alias("_s")).distinct()), F.col(stratum) == F.col("_s"), "left_semi")
    picked = written(numbered(own, stratum, order).join(wanted, (F.col(stratum) == F.col("_stratum")) & (F.col("rank") == F.col("_rank"))).drop("_stratum", "_rank", "rank"))
    placed = numbered(picked.withColumn("_all", F.lit("")), "_all", order)
    splits = spark.createDataFrame(list(enumerate(marks)), "rank long, split string")
    return placed.join(F.broadcast(splits), "rank").drop("rank", "_all")


def layered_sample(rows: DataFrame, layers: list[tuple[str, Column, int]], key: list[str], order: list[Column], most: int = 0) -> DataFrame:
    """rows taken by layers (name, condition, count), with `layer`: each in turn takes its first rows in the given order that no earlier layer has, `most` of a
    layer at most where that isn't 0. A layer with its own order is (name, condition, count, order). No key is taken twice, also where rows repeat it; layers without rows
    take nothing. Picks are as few as the counts, so they are broadcast."""
    taken, out = None, None
    for name, condition, count, *own in layers:
        free = rows.where(condition)
        if taken is not None:
            free = free.join(F.broadcast(taken.select(*key)), key, "left_anti")
        first = free.groupBy(*key).agg(F.min(F.struct(*(c for c in rows.columns if c not in key))).alias("_r")).select(*key, "_r.*").select(*rows.columns)
        pick = written(first.orderBy(*(own[0] if own else order)).limit(min(count, most) if most > 0 else count).withColumn("layer", F.lit(name)))
        taken = pick.select(*key) if taken is None else taken.unionByName(pick.select(*key))
        out = pick if out is None else out.unionByName(pick)
    return out
