"""Joins of frames with poses, boxes and the nearest message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import moved, moved_yaw
from ..schema import MATRIX, SHIFT

#: Keys by which a JSON object counts as boxes for all frames. Fixed values.
GLOBAL_KEYS = ("objects", "detections", "boxes", "center", "x", "position", "pose", "size", "dimensions", "extent", "bbox", "box", "length", "width", "height", "l", "w", "h", "shape")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def frame_timestamp(path: Column) -> Column:
    """Nanoseconds named by an all-digit file stem, else null."""
    s = stem(path)
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))


def latest_poses(poses: DataFrame, order: str) -> DataFrame:
    """One pose for each timestamp, the last by order."""
    others = [c for c in poses.columns if c not in ("timestamp_ns", order)]
    return poses.groupBy("timestamp_ns").agg(F.max_by(F.struct(*others), order).alias("_p")).select("timestamp_ns", "_p.*")


def join_poses(rows: DataFrame, poses: DataFrame, strict: bool = True) -> DataFrame:
    """rows with timestamp_ns to their pose. A missing timestamp or pose is an error, or drops the row if not strict."""
    known = poses.select("timestamp_ns", *MATRIX, *SHIFT)
    if not strict:
        return rows.join(known, "timestamp_ns")
    joined = rows.join(known, "timestamp_ns", "left")
    what = F.when(F.col("timestamp_ns").isNull(), F.lit("frame path has no timestamp")).otherwise(F.concat(F.lit("no pose for timestamp "), F.col("timestamp_ns").cast("string")))
    return joined.withColumn("r00", F.when(F.col("r00").isNull(), F.raise_error(what).cast("double")).otherwise(F.col("r00")))


def move_points(posed: DataFrame) -> DataFrame:
    x, y, z = moved(F.col("x"), F.col("y"), F.col("z"))
    return posed.withColumns({"x": x, "y": y, "z": z}).drop(*MATRIX, *SHIFT)


def move_boxes(posed: DataFrame) -> DataFrame:
    x, y, z = moved(F.col("cx"), F.col("cy"), F.col("cz"))
    return posed.withColumns({"cx": x, "cy": y, "cz": z, "yaw": moved_yaw(F.col("yaw"))}).drop(*MATRIX, *SHIFT)


def origin(points: DataFrame, frame: str = "frame_id") -> DataFrame:
    """The mean of the first frame that has points, as one row ox, oy, oz."""
    per = points.groupBy(frame).agg(*[F.avg(a).alias(f"o{a}") for a in "xyz"])
    return per.orderBy(frame).limit(1).select("ox", "oy", "oz")


def shift_origin(rows: DataFrame, origin_row: DataFrame, columns: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    out = rows.crossJoin(F.broadcast(origin_row.limit(1)))
    return out.withColumns({c: F.col(c) - F.col(f"o{a}") for c, a in zip(columns, "xyz", strict=True)}).drop("ox", "oy", "oz")


def resolve_payloads(frames: DataFrame, payloads: DataFrame, path: str = "path") -> DataFrame:
    """frames (path) to the payload of the first of their names that payloads (key, payload) knows, else null.

    Names in order: parent folder, file name, stem, parent/name, whole path.
    """
    p = F.col(path)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    parent = F.regexp_extract(p, r"([^/]+)/[^/]+$", 1)
    names = F.array(parent, name, stem(p), F.concat_ws("/", parent, name), p)
    asked = frames.select(path, F.posexplode(names).alias("rank", "key"))
    found = asked.join(payloads.select("key", "payload"), "key").groupBy(path).agg(F.min_by("payload", "rank").alias("payload"))
    return frames.join(found, path, "left")


def is_global_payload(text: Column) -> Column:
    """Whether a JSON document holds boxes for all frames: a list, or an object with a key of a payload."""
    v = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)) | F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, GLOBAL_KEYS))), F.lit(False))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, stamp: str = "stamp", key: str = "left_id", order: str = "arrival") -> DataFrame:
    """Each left row with the right row nearest in time, strictly within the tolerance; of equals the earliest arrival. Rows without one are left out.

    Stamps are dealt into buckets as long as the tolerance. A right row is listed under its own
    bucket and both neighbours, so the join is an equi-join however long the tables are.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(tolerance)))
    r = right.withColumnRenamed(stamp, "_right_stamp")
    r = r.withColumn("_b", F.explode(F.sequence(bucket("_right_stamp") - 1, bucket("_right_stamp") + 1)))
    joined = left.withColumn("_b", bucket(stamp)).join(r, "_b").withColumn("_gap", F.abs(F.col(stamp) - F.col("_right_stamp"))).filter(F.col("_gap") < tolerance)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_gap", order))
    return joined.withColumn("_n", first).filter("_n = 1").drop("_n", "_b").withColumnsRenamed({"_right_stamp": "right_stamp", "_gap": "gap"})
