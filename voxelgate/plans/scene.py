"""Whole runs: a sequence of frames to an accumulated map, and its scene document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_voxels
from ..operators import accumulate as acc
from ..operators.align import join_poses, move_boxes, move_points, origin, shift_origin
from ..operators.crop import MARGIN, mark_points
from ..operators.frames import object_list, sample_each_frame, sample_parts, sample_points
from ..operators.temporal import MIN_HITS, VOXEL_SIZE, WINDOW_SIZE, keep_persistent
from ..sources.shared import checkpoint


@dataclass(frozen=True)
class Sequence:
    """marked: points with voxels and keep. boxes: aligned, or None where persistence decides."""

    marked: DataFrame
    boxes: DataFrame | None
    voxel_size: float


def accumulate(points: DataFrame, boxes: DataFrame | None = None, poses: DataFrame | None = None, voxel_size: float = VOXEL_SIZE, window_size: int = WINDOW_SIZE, min_hits: int = MIN_HITS, margin: tuple[float, float, float] = MARGIN) -> Sequence:
    """Frames (frame_id, timestamp_ns where poses are given) in one coordinate system, with the points to keep.

    Boxes decide where there are some, else persistence. The origin is the mean of the first frame.
    """
    if poses is not None:
        points = move_points(join_poses(points, poses))
        boxes = move_boxes(join_poses(boxes, poses)) if boxes is not None else None
    start = origin(points)
    points = shift_origin(points, start)
    if boxes is not None:
        boxes = shift_origin(boxes, start, ("cx", "cy", "cz"))
        return Sequence(with_voxels(mark_points(points, boxes, margin), voxel_size), boxes, voxel_size)
    return Sequence(keep_persistent(points, voxel_size, window_size, min_hits), None, voxel_size)


def document(run: Sequence, sample: int = 2500, seed: int = 7) -> DataFrame:
    """The scene as one JSON text: totals, limits, path, bird's-eye view and frames with sampled points.

    The text has all ground cells and frames, so it is for sequences that one machine can show;
    write_scene is for any.
    """
    marked, size = run.marked, run.voxel_size
    voxels = checkpoint(acc.by_voxel(marked))
    totals = checkpoint(acc.frame_totals(voxels))
    seen = checkpoint(acc.both_views(voxels))
    clean, ghost = acc.clean_view(seen), acc.ghost_view(seen)
    place = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda r: F.array(r["x"], r["y"], r["cells"].cast("double")))
    views = []
    for name, cells in (("clean", clean), ("ghost", ghost)):
        rows = F.struct("vx", "vy", "x", "y", "cells")
        views.append(acc.with_places(cells, size).agg(F.flatten(place(rows)).alias(name), F.coalesce(F.max("cells"), F.lit(0)).alias(f"max_{name}_count")))
    bounds = acc.merge_bounds(acc.view_bounds(clean, size), acc.view_bounds(ghost, size)).select(F.struct("*").alias("bounds"))
    bev = views[0].crossJoin(views[1]).crossJoin(bounds).select(F.struct("bounds", "clean", "ghost", F.lit(size).alias("voxel_size"), "max_clean_count", "max_ghost_count").alias("bev"))
    xyz = F.transform(F.array_sort(F.collect_list(F.struct("point_id", "x", "y", "z"))), lambda p: F.array(*[F.bround(p[a], 3) for a in "xyz"]))
    frames = totals.select("frame_id", "input_points", "kept_points", "removed_points").join(acc.cumulative_voxels(voxels), "frame_id").join(totals.select("frame_id", "cx", "cy", "cz"), "frame_id")
    for name, rows in sample_parts(marked, totals, sample, seed).items():
        frames = frames.join(rows.groupBy("frame_id").agg(F.flatten(xyz).alias(name)), "frame_id", "left")
    if run.boxes is not None:
        frames = frames.join(object_list(run.boxes, frame="frame_id"), "frame_id", "left")
    rest = [c for c in frames.columns if c not in ("cx", "cy", "cz")]
    listed = F.array_sort(F.collect_list(F.struct("frame_seq", F.struct(*rest).alias("f"), F.array("cx", "cy", "cz").alias("c"))))
    body = frames.agg(F.transform(listed, lambda r: r["f"]).alias("frames"), F.transform(listed, lambda r: r["c"]).alias("path"), F.sum("input_points").alias("input_points"), F.sum("kept_points").alias("kept_points"), F.sum("removed_points").alias("removed_points"))
    limits = acc.limits(voxels).select(F.struct("*").alias("limits"))
    whole = body.crossJoin(limits).crossJoin(bev)
    meta = F.struct("input_points", "kept_points", "removed_points", F.size("frames").alias("frame_count"))
    return whole.select(F.to_json(F.struct(meta.alias("meta"), "limits", "path", "bev", "frames")).alias("document"))


def scan_document(points: DataFrame, boxes: DataFrame, source: str, sample: int = 20_000, seed: int = 7, margin: tuple[float, float, float] = MARGIN) -> DataFrame:
    """One scan as one JSON text: totals, the first box, sampled points (all, kept, removed), limits and objects.

    points and boxes have the same frame_id throughout. Only samples and boxes are gathered.
    """
    marked = mark_points(points, boxes, margin)
    xyz = F.transform(F.array_sort(F.collect_list(F.struct("point_id", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"]))
    shown = [sample_points(rows, sample, seed).agg(xyz.alias(name)) for name, rows in (("input", marked), ("kept", marked.filter("keep")), ("removed", marked.filter(~F.col("keep"))))]
    total, kept = F.count(F.lit(1)), F.count_if("keep")
    ends = [f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    body = marked.agg(total.alias("input_points"), kept.alias("output_points"), (total - kept).alias("removed_points"), *ends)
    body = body.crossJoin(object_list(boxes)).crossJoin(shown[0]).crossJoin(shown[1]).crossJoin(shown[2])
    first = F.get("objects", F.lit(0))
    none = lambda: F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    box = F.struct(F.coalesce(first["center"], none()).alias("center"), F.coalesce(first["size"], none()).alias("size"), F.coalesce(first["yaw"], F.lit(0.0)).alias("yaw"), F.when(first.isNull(), F.lit("scan")).otherwise(first["label"]).alias("label"))
    limits = F.struct(*[F.col(f"{a}{n}") for a in "xyz" for n in ("min", "max")], F.transform(first["size"], lambda s: s / 2.0).alias("box_half"), first["center"].alias("box_center"))
    meta = F.struct("input_points", "output_points", "removed_points", F.lit(source).alias("source"), F.size("objects").alias("objects"))
    return body.select(F.to_json(F.struct(meta.alias("meta"), box.alias("box"), F.struct("input", "kept", "removed").alias("points"), limits.alias("limits"), "objects")).alias("document"))


def write_scene(run: Sequence, folder: str, sample: int = 2500, seed: int = 7) -> None:
    """The scene of a sequence of any size as folders of JSON lines: frames, sampled points, clean and ghost cells, and its bounds.

    Nothing is gathered into one row, unlike in document.
    """
    marked = run.marked
    voxels = checkpoint(acc.by_voxel(marked))
    seen = acc.both_views(voxels)
    per = acc.frame_totals(voxels).join(acc.cumulative_voxels(voxels), "frame_id")
    shown = sample_each_frame(marked, sample, seed).select("frame_id", "point_id", *[F.bround(a, 3).alias(a) for a in "xyz"], "keep")
    parts = {"frames": per, "points": shown, "cells": acc.with_places(acc.merged_view(seen), run.voxel_size), "limits": acc.limits(voxels)}
    if run.boxes is not None:
        parts["objects"] = run.boxes.select("frame_id", "box_id", "cx", "cy", "cz", "l", "w", "h", "yaw", "label")
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
