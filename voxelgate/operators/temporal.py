"""Voxel persistence: points stay whose voxel was seen in enough of the last frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import with_voxels
from ..sources.shared import checkpoint
from .ordering import ranked

VOXEL_SIZE, WINDOW_SIZE, MIN_HITS = 0.10, 5, 3
CELL = ["vx", "vy", "vz"]
#: Voxels of frames that are broadcast to the points (some 60 MB); more are joined by a shuffle of the points.
_BROADCAST_VOXELS = 500_000


def check_settings(voxel_size: float, window_size: int, min_hits: int) -> None:
    for name, value in (("voxel_size", voxel_size), ("window_size", window_size), ("min_hits", min_hits)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def number_frames(points: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Frames with points, and their numbers without gaps, from 1."""
    return ranked(points.select(frame).distinct(), frame, "frame_seq")[0]


def voxel_hits(points: DataFrame, voxel_size: float = VOXEL_SIZE, window_size: int = WINDOW_SIZE, frame: str = "frame_id") -> DataFrame:
    """For each voxel of each frame: in how many of the last window_size frames with points (itself included) it was seen."""
    cells = with_voxels(points, voxel_size).select(frame, *CELL).distinct().join(number_frames(points, frame), frame)
    recent = Window.partitionBy(*CELL).orderBy("frame_seq").rangeBetween(-(window_size - 1), Window.currentRow)
    return cells.withColumn("hits", F.count(F.lit(1)).over(recent))


def keep_persistent(points: DataFrame, voxel_size: float = VOXEL_SIZE, window_size: int = WINDOW_SIZE, min_hits: int = MIN_HITS, frame: str = "frame_id") -> DataFrame:
    """All points with their voxel and a column keep. The first min_hits - 1 frames keep nothing."""
    check_settings(voxel_size, window_size, min_hits)
    # points outnumber voxels by far where frames are dense, so they stay where they are if the voxels are few
    seen = checkpoint(voxel_hits(points, voxel_size, window_size, frame).select(frame, *CELL, (F.col("hits") >= min_hits).alias("keep")))
    few = seen.count() <= _BROADCAST_VOXELS
    return with_voxels(points, voxel_size).join(F.broadcast(seen) if few else seen, [frame, *CELL])
