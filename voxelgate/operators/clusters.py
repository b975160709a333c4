"""Boxes around clusters of points: connected ground cells, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connect_cells

#: Side of a cell, least points of a cluster, padding, least sizes and largest area and height. Fixed values.
GRID, MIN_POINTS = 0.85, 18
PADDING = (0.8, 0.8, 0.6)
LEAST = (GRID * 1.5, GRID * 1.5, 1.2)
MAX_AREA, MAX_HEIGHT, MAX_BOXES = 90.0, 8.0, 3


def derive_boxes(points: DataFrame, frame: str = "frame_id", order: str = "point_id") -> DataFrame:
    """For each frame at most three boxes, largest clusters first: rank, cx..h, yaw, label, points.

    Points are summed up by cell, cells are connected within tiles and then across their borders,
    so no task gathers a frame. Labels number the accepted clusters by their first point.
    """
    g = lambda a: F.floor(F.col(a) / F.lit(GRID))
    ends = [f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    cells = points.groupBy(frame, g("x").alias("gx"), g("y").alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), *ends)
    labelled = connect_cells(cells, frame)
    merged = labelled.groupBy(frame, "component").agg(F.sum("n").alias("points"), F.min("first").alias("first"), *[f(f"{a}{n}").alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    size = lambda a, i: F.greatest(F.col(f"{a}max") - F.col(f"{a}min") + PADDING[i], F.lit(LEAST[i]))
    sized = merged.filter(F.col("points") >= MIN_POINTS).withColumns({"l": size("x", 0), "w": size("y", 1), "h": size("z", 2)})
    sound = sized.filter((F.col("l") * F.col("w") <= MAX_AREA) & (F.col("h") <= MAX_HEIGHT))
    found = F.row_number().over(Window.partitionBy(frame).orderBy("first"))
    numbered = sound.withColumn("number", found)
    rank = F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("points"), "number"))
    middle = {f"c{a}": F.bround((F.col(f"{a}min") + F.col(f"{a}max")) * 0.5, 3) for a in "xyz"}
    out = numbered.withColumn("rank", rank).filter(F.col("rank") <= MAX_BOXES).withColumns(middle)
    return out.select(frame, "rank", "cx", "cy", "cz", *[F.bround(s, 3).alias(s) for s in "lwh"], F.lit(0.0).alias("yaw"), F.concat(F.lit("auto transient box "), F.col("number").cast("string")).alias("label"), "points")


def split_by_boxes(points: DataFrame, boxes: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Points marked by boxes as they are, without a margin."""
    from .crop import mark_points

    return mark_points(points, boxes, (0.0, 0.0, 0.0), frame)
