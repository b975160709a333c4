"""Accumulated maps: cumulative voxels, ghost ratios, bird's-eye views, bounds and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite
from .ordering import running
from .temporal import CELL

EMPTY_BOUND = 1.0
CROP_CELLS = 5.5


def cumulative_voxels(marked: DataFrame, frame: str = "frame_id") -> DataFrame:
    """For each frame: voxels seen so far in all points (raw), in kept points (clean), in raw only (ghost), and ghost_pct of raw.

    A voxel counts from the frame that first has it, so sums of new voxels replace growing sets;
    one grouping by voxel finds the first frame of all its points and of the kept ones.
    """
    firsts = marked.groupBy(*CELL).agg(F.min(frame).alias("raw"), F.min(F.when(F.col("keep"), F.col(frame))).alias("clean"))
    new = firsts.select(F.explode(F.array(F.struct(F.col("raw").alias(frame), F.lit(1).alias("raw"), F.lit(0).alias("clean")), F.struct(F.col("clean").alias(frame), F.lit(0).alias("raw"), F.lit(1).alias("clean")))).alias("n")).select("n.*")
    seen = marked.select(frame, F.lit(0).alias("raw"), F.lit(0).alias("clean")).distinct()
    counted = new.filter(F.col(frame).isNotNull()).unionByName(seen).groupBy(frame).agg(F.sum("raw").alias("raw_new"), F.sum("clean").alias("clean_new")).withColumn("_one", F.lit(1))
    out = running(counted, frame, {"frame_seq": "_one", "raw": "raw_new", "clean": "clean_new"})[0].select(frame, "frame_seq", "raw", "clean")
    # kept points are some of the points, so clean voxels are some of the raw ones
    return out.withColumn("ghost", F.col("raw") - F.col("clean")).withColumn("ghost_pct", 100.0 * F.col("ghost") / F.greatest(F.lit(1), F.col("raw")))


def prefix_counts(marked: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Points, kept points and path length up to each frame."""
    per = marked.groupBy(frame).agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("k")).withColumn("_one", F.lit(1))
    return running(per, frame, {"points": "n", "kept": "k", "path": "_one"})[0].select(frame, "points", "kept", "path")


def prefix(points: DataFrame, upto, frame: str = "frame_id") -> DataFrame:
    """The points of all frames up to one."""
    return points.filter(F.col(frame) <= F.lit(upto))


def centres(points: DataFrame, frame: str = "frame_id") -> DataFrame:
    return points.groupBy(frame).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])


def centroid(points: DataFrame, fallback: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return points.agg(*[F.coalesce(F.avg(a), F.lit(float(f))).alias(f"c{a}") for a, f in zip("xyz", fallback, strict=True)])


def per_frame(marked: DataFrame, frame: str = "frame_id") -> DataFrame:
    total, kept = F.count(F.lit(1)), F.count_if("keep")
    return marked.groupBy(frame).agg(total.alias("input_points"), kept.alias("kept_points"), (total - kept).alias("removed_points"))


def by_voxel(marked: DataFrame, frame: str = "frame_id") -> DataFrame:
    """For each voxel of each frame and for its kept and other points: how many there are, and the sums and bounds of their coordinates.

    What a scene says about all points follows from these rows, so one pass over the points does.
    """
    sums = []
    for a in "xyz":
        sound = F.when(finite(a), F.col(a))
        sums += [F.sum(a).alias(f"sum_{a}"), F.count(a).alias(f"n_{a}"), F.min(sound).alias(f"{a}min"), F.max(sound).alias(f"{a}max")]
    return marked.groupBy(frame, *CELL, "keep").agg(F.count(F.lit(1)).alias("n"), *sums)


def frame_totals(cells: DataFrame, frame: str = "frame_id") -> DataFrame:
    """per_frame and centres, from the rows of by_voxel."""
    total, kept = F.sum("n"), F.sum(F.when(F.col("keep"), F.col("n")).otherwise(0))
    means = [F.try_divide(F.sum(f"sum_{a}"), F.sum(f"n_{a}")).alias(f"c{a}") for a in "xyz"]
    return cells.groupBy(frame).agg(total.alias("input_points"), kept.alias("kept_points"), (total - kept).alias("removed_points"), *means)


def most_removed(marked: DataFrame, frame: str = "frame_id") -> DataFrame:
    """The frame with most removed points, the first of equals."""
    return per_frame(marked, frame).orderBy(F.desc("removed_points"), frame).limit(1)


def peak(cumulative: DataFrame, around: int = 2, frame: str = "frame_id") -> DataFrame:
    """The frame of the highest ghost_pct (the first of equals), the frames around it, and the final reduction."""
    last = cumulative.agg(F.max("frame_seq").alias("n"), F.max_by("ghost_pct", "frame_seq").alias("final_pct"))
    top = cumulative.orderBy(F.desc("ghost_pct"), "frame_seq").limit(1).crossJoin(last)
    at = F.col("frame_seq") - 1
    return top.select(frame, at.alias("peak_index"), F.greatest(F.lit(0), at - around).alias("window_start"), F.least(F.col("n") - 1, at + around).alias("window_end"), "ghost_pct", F.bround(100.0 - F.col("final_pct"), 1).alias("reduction_pct"))


def timeline(cumulative: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Ghost ratios in order, and the top of their scale."""
    return cumulative.select(frame, "frame_seq", "ghost_pct", F.greatest(F.lit(1.0), F.max("ghost_pct").over(Window.partitionBy())).alias("scale"))


def birds_eye(voxels: DataFrame) -> DataFrame:
    """Distinct voxels above each ground cell."""
    return voxels.select(*CELL).distinct().groupBy("vx", "vy").agg(F.count(F.lit(1)).alias("cells"))


def with_places(cells: DataFrame, voxel_size: float) -> DataFrame:
    """Cell middles, to three decimals."""
    return cells.withColumns({a: F.bround((F.col(f"v{a}") + 0.5) * voxel_size, 3) for a in "xy"})


def ghost_voxels(marked: DataFrame) -> DataFrame:
    """Voxels of all points that no kept point is in."""
    return marked.select(*CELL).distinct().join(marked.filter("keep").select(*CELL).distinct(), CELL, "left_anti")


def view_bounds(cells: DataFrame, voxel_size: float) -> DataFrame:
    """Bounds of cell middles; without cells, -1 to 1."""
    placed = with_places(cells, voxel_size)
    ends = []
    for a in "xy":
        ends += [F.coalesce(F.min(a), F.lit(-EMPTY_BOUND)).alias(f"{a}min"), F.coalesce(F.max(a), F.lit(EMPTY_BOUND)).alias(f"{a}max")]
    return placed.agg(*ends, F.coalesce(F.max("cells"), F.lit(0)).alias("max_cells"))


def merge_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bounds that hold both (each is one row)."""
    both = a.unionByName(b)
    return both.agg(*[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


def limits(points: DataFrame) -> DataFrame:
    """Bounds of the finite coordinates to three decimals; without any, -1 to 1. points may be the rows of by_voxel."""
    ends = []
    for a in "xyz":
        least, most = (F.col(f"{a}min"), F.col(f"{a}max")) if f"{a}min" in points.columns else [F.when(finite(a), F.col(a))] * 2
        ends += [F.bround(F.coalesce(F.min(least), F.lit(-EMPTY_BOUND)), 3).alias(f"{a}min"), F.bround(F.coalesce(F.max(most), F.lit(EMPTY_BOUND)), 3).alias(f"{a}max")]
    return points.agg(*ends)


def exact_bounds(points: DataFrame) -> DataFrame:
    return points.agg(*[f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def both_views(marked: DataFrame) -> DataFrame:
    """Ground cells with clean_cells (voxels with a kept point) and ghost_cells (voxels without one), in one pass over the points."""
    voxels = marked.groupBy(*CELL).agg(F.max("keep").alias("kept"))
    return voxels.groupBy("vx", "vy").agg(F.count_if("kept").alias("clean_cells"), F.count_if(~F.col("kept")).alias("ghost_cells"))


def clean_view(views: DataFrame) -> DataFrame:
    return views.filter("clean_cells > 0").select("vx", "vy", F.col("clean_cells").alias("cells"))


def ghost_view(views: DataFrame) -> DataFrame:
    return views.filter("ghost_cells > 0").select("vx", "vy", F.col("ghost_cells").alias("cells"))


def merged_view(views: DataFrame) -> DataFrame:
    """Clean and ghost cells side by side with their sum."""
    return views.withColumn("total_cells", F.col("clean_cells") + F.col("ghost_cells"))


def near_ghosts(views: DataFrame) -> DataFrame:
    """Clean cells with near: the ghost count in the nine cells around each.

    Each cell is sent to its neighbours and itself, so one grouping replaces the range join.
    """
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("x"), F.lit(j).cast("long").alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = (F.col("d.x") == 0) & (F.col("d.y") == 0)
    sent = views.withColumn("d", F.explode(steps)).filter(here | (F.col("ghost_cells") > 0))
    near = sent.groupBy((F.col("vx") + F.col("d.x")).alias("vx"), (F.col("vy") + F.col("d.y")).alias("vy"))
    return near.agg(F.sum(F.when(here, F.col("clean_cells")).otherwise(0)).alias("cells"), F.sum("ghost_cells").alias("near")).filter("cells > 0")


def hotspot(views: DataFrame) -> DataFrame:
    """The cell with most ghost voxels; of equals the first by place."""
    return ghost_view(views).orderBy(F.desc("cells"), "vx", "vy").limit(1)


def preserved_spot(views: DataFrame) -> DataFrame:
    """The clean cell of the highest score among those without ghosts around, or among all where each has some."""
    scored = near_ghosts(views).withColumn("score", F.col("cells") * 1000 - F.col("near"))
    # cells without ghosts come first, if there are any
    return scored.orderBy(F.col("near") > 0, F.desc("score"), "vx", "vy").limit(1)


def crop_stats(views: DataFrame, focus: DataFrame, voxel_size: float) -> DataFrame:
    """Cells of each kind within the crop around focus (one row with vx, vy), and clean_pct of all."""
    at = with_places(focus.select("vx", "vy"), voxel_size).select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    reach = CROP_CELLS * voxel_size
    cells = with_places(views, voxel_size).crossJoin(F.broadcast(at.limit(1)))
    held = cells.filter((F.abs(F.col("x") - F.col("fx")) <= reach) & (F.abs(F.col("y") - F.col("fy")) <= reach))
    raw, kept = F.count(F.lit(1)), F.count_if(F.col("clean_cells") > 0)
    return held.agg(raw.alias("raw_cells"), kept.alias("clean_cells"), F.count_if(F.col("ghost_cells") > 0).alias("ghost_cells"), F.floor(100.0 * kept / F.greatest(F.lit(1), raw) + 0.5).alias("overlap_pct"))
