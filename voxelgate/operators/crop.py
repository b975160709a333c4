"""Removal of points in oriented boxes: an anti-join on the inside-box predicate.

Boxes are listed under the ground cells that their outlines reach, so frame and cell are equi-keys
and a point meets the boxes around it only, however many a frame has. A box that holds a point is
listed under the point's cell, and none of the joins here minds boxes that are listed often. Boxes
that reach many cells go by a hierarchy of grids: each has the level at which it reaches a few
cells, and the cells that have points, which are far fewer than the points, look their boxes up
at every level that occurs. So boxes of any size end in the same list, and the points take part in
one join. The list is broadcast where its counted size allows it.

Equal boxes are one. Where boxes are crowded, the grid is finer and a box is left out of a cell
that another one covers from side to side, as high and as low as itself, because no point there is
in the box alone. So a point meets few boxes, however many lie over each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite, inside, prepare_boxes
from ..sources.shared import checkpoint

MARGIN = (0.05, 0.05, 0.05)
#: Side of a ground cell, about the length of a car.
CELL = 6.0
#: A box that reaches at most so many cells is listed under each of them; larger ones only under cells that have points.
LISTED_CELLS = 64
#: Listed boxes up to which the list is broadcast (some 100 bytes each).
BROADCAST_ROWS = 500_000
#: Boxes listed under one cell from which on the grid is finer, and the most that its cells' sides are divided by.
CROWDED, FINEST = 64, 16
#: The highest level of the hierarchy, and the one whose only cell is everywhere.
_TOP, _EVERYWHERE = 40, 63
_BOX = ("cx", "cy", "cz", "hx", "hy", "hz", "cos_yaw", "sin_yaw")


def drop_small_boxes(boxes: DataFrame, min_size: float = 0.01) -> DataFrame:
    """Boxes of at least min_size along each side; with a min_size of 0 or less, all of them."""
    if min_size <= 0:
        return boxes
    large = F.lit(True)
    for side in "lwh":
        large = large & (F.col(side) >= min_size) & ~F.isnan(side)
    return boxes.filter(large)


def _cells(value: str, cell: float) -> Column:
    return F.floor(F.col(value) / cell)


def _needed(listed: DataFrame, key: list[str], cell: float) -> DataFrame:
    """The listed boxes without those that don't reach their cell after all, or in which another one covers the cell and all their height."""
    mx, my = (F.col("_gx") + 0.5) * cell, (F.col("_gy") + 0.5) * cell
    dx, dy = mx - F.col("cx"), my - F.col("cy")
    # far more than rounding can be off by
    slack = F.lit(1e-9) * (1 + F.abs(mx) + F.abs(my) + F.abs("cx") + F.abs("cy"))
    reach = F.lit(cell / 2) * (F.abs("cos_yaw") + F.abs("sin_yaw")) + slack
    sides = listed.withColumns({"_ax": F.abs(F.col("cos_yaw") * dx - F.col("sin_yaw") * dy), "_ay": F.abs(F.col("sin_yaw") * dx + F.col("cos_yaw") * dy), "_reach": reach})
    near = sides.filter((F.col("_ax") <= F.col("hx") + F.col("_reach")) & (F.col("_ay") <= F.col("hy") + F.col("_reach")))
    covers = (F.col("_ax") + F.col("_reach") <= F.col("hx")) & (F.col("_ay") + F.col("_reach") <= F.col("hy")) & finite("cz") & finite("hz")
    own = F.struct("hz", "cz", *[c for c in _BOX if c not in ("hz", "cz")])
    ranked = near.withColumn("_best", F.max(F.when(covers, own)).over(Window.partitionBy(*key, "_gx", "_gy")))
    high, at = F.col("_best.hz"), F.col("_best.cz")
    within = ((F.col("cz") == at) & (F.col("hz") <= high)) | (F.abs(F.col("cz") - at) + F.col("hz") <= high - F.lit(1e-9) * (1 + F.abs("cz") + F.abs(at) + high))
    return ranked.filter(F.col("_best").isNull() | (own == F.col("_best")) | ~within).select(*listed.columns)


def prepare(points: DataFrame, boxes: DataFrame, margin: tuple[float, float, float], frame: str | None, cell: float) -> tuple[DataFrame, float]:
    """Prepared boxes, once for each ground cell (_gx, _gy) that they reach and that may have points, and the side of the cells.

    The boxes are counted first, which is a job of its own over them, and where they are crowded the
    cells are smaller than asked for. A box whose centre isn't a number has no cell, and holds no point.
    """
    key = [frame] if frame else []
    once = prepare_boxes(boxes, margin).filter(finite("cx") & finite("cy")).select(*key, *_BOX).distinct()
    few = once.agg(F.count(F.lit(1))).first()[0] <= CROWDED
    most = 0 if few else _places(once, key, cell).groupBy(*key, "_gx", "_gy").count().agg(F.max("count")).first()[0] or 0
    if most <= CROWDED:
        return _listed(points, once, key, cell), cell
    cell /= min(FINEST, 2 ** math.ceil(math.log2(most / CROWDED) / 2 + 1))
    listed = checkpoint(_needed(_listed(points, checkpoint(once), key, cell, hint=False), key, cell))
    return F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed, cell


def _places(once: DataFrame, key: list[str], cell: float) -> DataFrame:
    """The cell of each box's centre."""
    return once.select(*key, _cells("cx", cell).alias("_gx"), _cells("cy", cell).alias("_gy"))


def _listed(points: DataFrame, once: DataFrame, key: list[str], cell: float, hint: bool = True) -> DataFrame:
    """The boxes under their cells, with a hint to broadcast them where they are few."""
    kept = [*key, *_BOX]
    placed = once.select(*kept, (F.col("hx") * F.abs("cos_yaw") + F.col("hy") * F.abs("sin_yaw") + F.lit(1e-9)).alias("_rx"), (F.col("hx") * F.abs("sin_yaw") + F.col("hy") * F.abs("cos_yaw") + F.lit(1e-9)).alias("_ry"))
    reached = (2 * F.col("_rx") / cell + 2) * (2 * F.col("_ry") / cell + 2)
    large = reached > LISTED_CELLS
    height = F.ceil(F.log2(2 * F.greatest("_rx", "_ry") / cell))
    level = F.when(F.greatest("_rx", "_ry") < cell * 2.0**_TOP, height).otherwise(F.lit(_EVERYWHERE)).cast("int")
    counted = placed.agg(F.sum(F.when(~large, reached)).alias("rows"), F.collect_set(F.when(large, level)).alias("levels")).first()
    first, last = (lambda c: F.floor((F.col(f"c{c}") - F.col(f"_r{c}")) / cell)), (lambda c: F.floor((F.col(f"c{c}") + F.col(f"_r{c}")) / cell))
    span = lambda c: F.sequence(first(c), last(c))
    listed = placed.filter(~large).select(*kept, F.explode(span("x")).alias("_gx"), span("y").alias("_ys")).select(*kept, "_gx", F.explode("_ys").alias("_gy"))
    if not counted["levels"]:
        return F.broadcast(listed) if hint and (counted["rows"] or 0) <= BROADCAST_ROWS else listed
    high = placed.filter(large).withColumn("_level", level)
    # shifts by a column's value need an expression in SQL
    high = high.withColumns({"_x0": first("x"), "_x1": last("x"), "_y0": first("y"), "_y1": last("y")})
    climb = lambda c: F.expr(f"CASE WHEN _level = {_EVERYWHERE} THEN 0L ELSE shiftright({c}, _level) END")
    high = high.select(*kept, "_level", F.explode(F.sequence(climb("_x0"), climb("_x1"))).alias("_lx"), F.sequence(climb("_y0"), climb("_y1")).alias("_ys")).select(*kept, "_level", "_lx", F.explode("_ys").alias("_ly"))
    cells = points.select(*key, _cells("x", cell).alias("_gx"), _cells("y", cell).alias("_gy")).distinct()
    cells = cells.select("*", F.explode(F.array(*map(F.lit, sorted(counted["levels"])))).alias("_level")).withColumns({"_lx": climb("_gx"), "_ly": climb("_gy")})
    return listed.unionByName(cells.join(high, [*key, "_level", "_lx", "_ly"]).select(*kept, "_gx", "_gy"))


def _sides(points: DataFrame, boxes: DataFrame, frame: str | None) -> Column:
    test = inside({a: points[a] for a in "xyz"}, {c: boxes[c] for c in _BOX})
    return (points[frame] == boxes[frame]) & test if frame else test


def remove_points(points: DataFrame, boxes: DataFrame, margin: tuple[float, float, float] = MARGIN, frame: str | None = "frame_id", cell: float = CELL) -> DataFrame:
    """Points in no box of their frame (of all boxes, if frame is None); the first box that holds a point decides."""
    listed, cell = prepare(points, boxes, margin, frame, cell)
    at = points.withColumns({"_px": _cells("x", cell), "_py": _cells("y", cell)})
    return at.join(listed, (at["_px"] == listed["_gx"]) & (at["_py"] == listed["_gy"]) & _sides(at, listed, frame), "left_anti").drop("_px", "_py")


def points_in_boxes(points: DataFrame, boxes: DataFrame, margin: tuple[float, float, float] = MARGIN, frame: str = "frame_id", cell: float = CELL) -> DataFrame:
    """The other side of remove_points."""
    return mark_points(points, boxes, margin, frame, cell).filter("NOT keep").drop("keep")


def mark_points(points: DataFrame, boxes: DataFrame, margin: tuple[float, float, float] = MARGIN, frame: str = "frame_id", cell: float = CELL) -> DataFrame:
    """All points with a column keep, by an existence join: lookups for each point, and none is repeated."""
    listed, cell = prepare(points, boxes, margin, frame, cell)
    renamed = listed.select(*[F.col(c).alias(f"_box_{c}") for c in listed.columns])
    # names that nothing in the boxes has, so that they can only be those of the points
    own = {f"_point_{c}": F.col(c) for c in (frame, "x", "y", "z")} | {"_point_gx": _cells("x", cell), "_point_gy": _cells("y", cell)}
    mine = lambda c: F.col(f"_point_{c}").outer()
    held = (F.col(f"_box_{frame}") == mine(frame)) & inside({a: mine(a) for a in "xyz"}, {c: F.col(f"_box_{c}") for c in _BOX})
    near = renamed.filter((F.col("_box__gx") == mine("gx")) & (F.col("_box__gy") == mine("gy")) & held).exists()
    return points.withColumns(own).withColumn("keep", ~near).drop(*own)


def summarise(marked: DataFrame) -> DataFrame:
    """One row of totals of points with a column keep."""
    kept = F.count_if("keep")
    total = F.count(F.lit(1))
    return marked.agg(total.alias("total_points"), kept.alias("kept_points"), (total - kept).alias("removed_points"), F.coalesce(F.try_divide(total - kept, total), F.lit(0.0)).alias("removed_ratio"))
