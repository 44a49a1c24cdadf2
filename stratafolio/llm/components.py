"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of links (a, b): component is the smallest id reachable.

    Each round takes the smallest label among the neighbours (with map-side minima, so a hub costs a
    row a task) and then follows labels twice, which shortens chains by squaring. Every round is written to the
    shared folder. Labels only fall, so the rounds end.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = written(labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component")))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = low.join(jump, "component", "left").select("id", "was", F.coalesce("next", "component").alias("component"))
        after = written(jumped)
        moved = after.where("component <> was").limit(1).count()
        dropped(labels, low)
        labels = after.select("id", "component")
        if not moved:
            dropped(both)
            return labels
