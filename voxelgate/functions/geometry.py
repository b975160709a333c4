"""Column expressions for boxes, voxels, rotations and rigid transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rotations by less than this are none.
NO_ROTATION = 1e-12
_LOWEST = -(1 << 63)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def voxel(x: Column | str, size: float) -> Column:
    """Cell of a coordinate; what isn't finite has the lowest one, away from all others."""
    x = col(x)
    return F.when(finite(x), F.floor(x / F.lit(float(size)))).otherwise(F.lit(_LOWEST).cast("long"))


def with_voxels(points: DataFrame, size: float) -> DataFrame:
    if size <= 0:
        raise ValueError("voxel_size must be positive")
    return points.withColumns({f"v{a}": voxel(a, size) for a in "xyz"})


def prepare_boxes(boxes: DataFrame, margin: tuple[float, float, float] = (0.05, 0.05, 0.05)) -> DataFrame:
    """Adds half sizes hx, hy, hz with the margin and the cosine and sine of -yaw, once for each box.

    A box with a half size that isn't positive (or is NaN) can't hold a point and is left out.
    """
    if len(margin) != 3:
        raise ValueError("margin must have 3 elements")
    turned = F.abs("yaw") >= NO_ROTATION
    halves = {f"h{a}": F.col(side) * 0.5 + F.lit(float(m)) for a, side, m in zip("xyz", "lwh", margin, strict=True)}
    out = boxes.withColumns(halves | {"cos_yaw": F.when(turned, F.cos(-F.col("yaw"))).otherwise(F.lit(1.0)), "sin_yaw": F.when(turned, F.sin(-F.col("yaw"))).otherwise(F.lit(0.0))})
    held = F.lit(True)
    for a in "xyz":
        held = held & (F.col(f"h{a}") > 0) & ~F.isnan(f"h{a}")
    return out.filter(held)


def inside(p: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether a point lies in a prepared box; faces belong to it."""
    dx, dy, dz = p["x"] - b["cx"], p["y"] - b["cy"], p["z"] - b["cz"]
    lx = b["cos_yaw"] * dx - b["sin_yaw"] * dy
    ly = b["sin_yaw"] * dx + b["cos_yaw"] * dy
    # NaN sorts above all numbers, so it is never within
    return (F.abs(lx) <= b["hx"]) & (F.abs(ly) <= b["hy"]) & (F.abs(dz) <= b["hz"])


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def quaternion_matrix(poses: DataFrame) -> DataFrame:
    """Poses with qw, qx, qy, qz to r00..r22, of the normalised quaternion; a zero one is an error."""
    norm = F.sqrt(F.col("qw") * F.col("qw") + F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))
    safe = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("quaternion norm must be non-zero")).cast("double"))
    unit = poses.withColumn("_n", safe).withColumns({f"_{a}": F.col(f"q{a}") / F.col("_n") for a in "wxyz"})
    w, x, y, z = (F.col(f"_{a}") for a in "wxyz")
    cells = {
        "r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y - z * w), "r02": 2 * (x * z + y * w),
        "r10": 2 * (x * y + z * w), "r11": 1 - 2 * (x * x + z * z), "r12": 2 * (y * z - x * w),
        "r20": 2 * (x * z - y * w), "r21": 2 * (y * z + x * w), "r22": 1 - 2 * (x * x + y * y),
    }
    return unit.withColumns(cells).drop("_n", "_w", "_x", "_y", "_z")


def moved(x: Column, y: Column, z: Column) -> list[Column]:
    """A place after the pose in r00..r22, tx, ty, tz."""
    return [F.col(f"r{i}0") * x + F.col(f"r{i}1") * y + F.col(f"r{i}2") * z + F.col(f"t{a}") for i, a in enumerate("xyz")]


def moved_yaw(yaw: Column) -> Column:
    """The heading after the pose."""
    c, s = F.cos(yaw), F.sin(yaw)
    return F.atan2(F.col("r10") * c + F.col("r11") * s, F.col("r00") * c + F.col("r01") * s)
