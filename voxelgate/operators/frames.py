"""Frame selection, sampling, latency figures and object lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoint
from .ordering import percentiles, ranked


def slice_frames(frames: DataFrame, start: int = 0, count: int | None = None, stride: int = 1, path: str = "path") -> DataFrame:
    """Frames in the order of their path, with their index: count of them from start on, stride apart. A negative start counts from the end."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    if count is not None and count <= 0:
        raise ValueError("count must be positive")
    at, n = ranked(frames, path, "index", 0)
    end = None if count is None else start + count * stride
    if start < 0:
        end = n if end is None else n + end if end < 0 else end
        start = max(0, n + start)
    kept = (F.col("index") >= start) & ((F.col("index") - start) % stride == 0)
    return at.filter(kept if end is None else kept & (F.col("index") < end))


def sample_order(key: str, seed: int) -> Column:
    """What a sample takes the first of: a hash that SQL has too."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_points(points: DataFrame, size: int, seed: int, key: str = "point_id") -> DataFrame:
    """Exactly size points (or all, if fewer), uniformly and without repeats; size of 0 or less keeps all. The same seed gives the same points."""
    if size <= 0:
        return points
    return points.orderBy(sample_order(key, seed), key).limit(size)


#: Frames whose counts are broadcast to the points (some 40 MB); more are joined by a shuffle.
_BROADCAST_FRAMES = 1_000_000


def sample_parts(marked: DataFrame, counts: DataFrame, size: int, seed: int, key: str = "point_id", frame: str = "frame_id") -> dict[str, DataFrame]:
    """sample_each_frame of all points (input), of the kept and of the removed ones, in one pass over the points.

    counts: frame, input_points, kept_points, removed_points. The bound of a point is that of its
    own part, which is no less than that of all points.
    """
    parts = {"input": F.lit(True), "kept": F.col("keep"), "removed": ~F.col("keep")}
    if size <= 0:
        return {name: marked.filter(part) for name, part in parts.items()}
    counts = checkpoint(counts.select(frame, *[f"{p}_points" for p in parts]))
    order = sample_order(key, seed)
    room, share = size + 6.0 * size**0.5 + 6.0, F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = F.broadcast(counts) if counts.count() <= _BROADCAST_FRAMES else counts
    own = F.when(F.col("keep"), F.col("kept_points")).otherwise(F.col("removed_points"))
    few = checkpoint(marked.join(known, frame).withColumn("_share", share).filter(F.col("_share") * own <= room))
    out = {}
    for name, part in parts.items():
        n = F.col(f"{name}_points")
        mine = few.filter(part & (F.col("_share") * n <= room)).select(*marked.columns)
        got = mine.groupBy(frame).agg(F.count(F.lit(1)).alias("_got"))
        short = checkpoint(counts.join(got, frame, "left").filter(F.coalesce("_got", F.lit(0)) < F.least(F.lit(size), n)).select(frame))
        if not short.isEmpty():
            mine = mine.join(short, frame, "left_anti").unionByName(marked.filter(part).join(short, frame, "left_semi"))
        place = F.row_number().over(Window.partitionBy(frame).orderBy(sample_order(key, seed), key))
        out[name] = mine.withColumn("_place", place).filter(F.col("_place") <= size).drop("_place")
    return out


def sample_each_frame(points: DataFrame, size: int, seed: int, key: str = "point_id", frame: str = "frame_id") -> DataFrame:
    """As sample_points, for each frame.

    The count of a frame bounds the hashes that can be among its first, with room for chance; the
    points below the bound alone are ordered. A frame that got too few by it is ordered whole.
    """
    if size <= 0:
        return points
    order = sample_order(key, seed)
    counts = checkpoint(points.groupBy(frame).agg(F.count(F.lit(1)).alias("_n")))
    bound = (size + 6.0 * size**0.5 + 6.0) / F.col("_n")
    share = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / float(1 << 32)
    few = checkpoint(points.join(counts, frame).filter(share <= bound).drop("_n"))
    got = few.groupBy(frame).agg(F.count(F.lit(1)).alias("_got"))
    short = checkpoint(counts.join(got, frame, "left").filter(F.coalesce("_got", F.lit(0)) < F.least(F.lit(size), F.col("_n"))).select(frame))
    if not short.isEmpty():
        few = few.join(short, frame, "left_anti").unionByName(points.join(short, frame, "left_semi"))
    place = F.row_number().over(Window.partitionBy(frame).orderBy(sample_order(key, seed), key))
    return few.withColumn("_place", place).filter(F.col("_place") <= size).drop("_place")


def latency(runs: DataFrame, value: str = "ms") -> DataFrame:
    """One row of mean, median, 95th percentile, largest and smallest; zeros without values."""
    mean, most, least = runs.agg(F.avg(value), F.max(value).cast("double"), F.min(value).cast("double")).first()
    half, high = percentiles(runs, value, [0.5, 0.95])
    row = tuple(x or 0.0 for x in (mean, half, high, most, least))
    return runs.sparkSession.createDataFrame([row], "mean_ms double, p50_ms double, p95_ms double, max_ms double, min_ms double")


def throughput(points: Column, mean_ms: Column) -> Column:
    """Thousands of points a second."""
    return F.coalesce(F.try_divide(points, mean_ms / 1000.0) / 1000.0, F.lit(0.0))


def object_list(boxes: DataFrame, order: str = "box_id", frame: str | None = None) -> DataFrame:
    """Boxes as one array of structs, in order."""
    item = F.struct(F.col(order).alias("_o"), "label", F.array("cx", "cy", "cz").alias("center"), F.array("l", "w", "h").alias("size"), "yaw")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["label"].alias("label"), x["center"].alias("center"), x["size"].alias("size"), x["yaw"].alias("yaw")))
    return boxes.groupBy(*([frame] if frame else [])).agg(listed.alias("objects"))
