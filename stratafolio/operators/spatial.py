"""Spatial joins by a grid: boxes and points of a page are dealt to cells, meet there, and are verified exactly, so that a page with many regions is not joined with itself whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers

BOX = ["x0", "y0", "x1", "y1"]


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _dealt(boxes: DataFrame, size: float) -> DataFrame:
    """boxes once for each cell that they touch."""
    across = F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size)))
    down = F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size)))
    return boxes.where("x0 <= x1 AND y0 <= y1").withColumn("cx", across).withColumn("cy", down)


def overlapping(boxes: DataFrame, others: DataFrame, page: list[str], size: float = 0.25) -> DataFrame:
    """page.., a, b, iou of the boxes (page.., id, x0, y0, x1, y1) and others that share more than an edge.

    A pair meets in every cell that both touch and is taken only in the one with the lower corner of what they share, so each comes once. `size` is a cell's side: near the side of
    a usual box, so that a box touches few cells and a cell few boxes. Boxes with a null or upside down touch nothing.
    """
    a = _dealt(boxes.select(*page, F.col("id").alias("a"), *(F.col(k).alias(k) for k in BOX)), size).select(*page, "cx", "cy", "a", F.struct(*BOX).alias("p"))
    b = _dealt(others.select(*page, F.col("id").alias("b"), *(F.col(k).alias(k) for k in BOX)), size).select(*page, "cx", "cy", "b", F.struct(*BOX).alias("q"))
    met = a.join(b, [*page, "cx", "cy"])
    x, y = F.greatest("p.x0", "q.x0"), F.greatest("p.y0", "q.y0")
    shares = (x < F.least("p.x1", "q.x1")) & (y < F.least("p.y1", "q.y1"))
    here = (_cell(x, size) == F.col("cx")) & (_cell(y, size) == F.col("cy"))
    value = numbers.iou([F.col(f"p.{k}") for k in BOX], [F.col(f"q.{k}") for k in BOX])
    return met.where(shares & here).select(*page, "a", "b", value.alias("iou"))


def owners(points: DataFrame, boxes: DataFrame, page: list[str], size: float = 0.25) -> DataFrame:
    """page.., id of the points (page.., id, x, y) with `region`, the one of boxes (page.., region, x0, y0, x1, y1) that holds it, and `overlapping` where several
    do. Boxes are closed at the upper left and open at the lower right. A point lies in one cell, so it meets only the boxes that touch it."""
    at = points.select(*page, "id", "x", "y", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
    dealt = _dealt(boxes.select(*page, "region", *BOX), size)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    held = at.join(dealt, [*page, "cx", "cy"]).where(inside).groupBy(*page, "id").agg(F.count("*").alias("n"), F.min("region").alias("region"))
    return points.select(*page, "id").join(held, [*page, "id"], "left").select(*page, "id", F.when(F.col("n") == 1, F.col("region")).alias("region"), (F.coalesce("n", F.lit(0)) > 1).alias("overlapping"))
