"""A made-up street scene: ground, a car and two walls."""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND, CAR, WALLS = 3000, 500, 2000
CAR_BOX = {"cx": 10.0, "cy": -2.0, "cz": -0.5, "l": 4.5, "w": 1.8, "h": 1.5, "yaw": 0.0, "label": "Car"}


def scene(spark: SparkSession, seed: int = 42, frame: str = "000000") -> DataFrame:
    """Points of one frame; the same seed gives the same points."""
    between = lambda low, high, k: F.lit(low) + (F.lit(high) - F.lit(low)) * F.rand(seed * 31 + k)
    ids = spark.range(GROUND + CAR + WALLS, numPartitions=1).withColumnRenamed("id", "point_id")
    ground, car = F.col("point_id") < GROUND, F.col("point_id") < GROUND + CAR
    side = F.when(F.col("point_id") % 2 == 0, 8.0).otherwise(-8.0)
    b = CAR_BOX
    place = lambda a, s, k: between(b[a] - b[s] / 2, b[a] + b[s] / 2, k)
    return ids.select(
        F.lit(frame).alias("frame_id"),
        "point_id",
        F.when(ground, between(0.0, 40.0, 1)).when(car, place("cx", "l", 4)).otherwise(between(0.0, 40.0, 7)).alias("x"),
        F.when(ground, between(-8.0, 8.0, 2)).when(car, place("cy", "w", 5)).otherwise(side).alias("y"),
        F.when(ground, F.lit(-1.7) + 0.02 * F.randn(seed)).when(car, place("cz", "h", 6)).otherwise(between(-1.7, 2.0, 8)).alias("z"),
    )


#: Lines of a calibration file whose lidar looks along z of the camera. Fixed values.
CALIBRATION = "P0: 1 0 0 0 0 1 0 0 0 0 1 0\nR0_rect: 1 0 0 0 1 0 0 0 1\nTr_velo_to_cam: 0 -1 0 0 0 0 -1 0 1 0 0 0\n"


def write_frames(spark: SparkSession, folder: str, frames: int = 5, seed: int = 42) -> None:
    """Frames 000000 on as files: velodyne/*.bin (records of four 32-bit floats), label_2/*.txt and calib/*.txt.

    The executors write them, a frame a task, into a folder that they share.
    """
    every = None
    for i in range(frames):
        one = scene(spark, seed + i, f"{i:06d}")
        every = one if every is None else every.unionByName(one)
    b = CAR_BOX
    # a label's place is the middle of the box's bottom, in the camera's axes
    label = f"Car 0 0 0 0 0 0 0 {b['h']} {b['w']} {b['l']} {-b['cy']} {-b['cz'] + b['h'] / 2} {b['cx']} 0\n"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["frame_id"].iloc[0]
        records = np.zeros((len(pdf), 4), "<f4")
        records[:, :3] = pdf.sort_values("point_id")[["x", "y", "z"]]
        for part, suffix, body in (("velodyne", "bin", records.tobytes()), ("label_2", "txt", label.encode()), ("calib", "txt", CALIBRATION.encode())):
            target = Path(folder, part, f"{name}.{suffix}")
            target.parent.mkdir(parents=True, exist_ok=True)
            partial = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            partial.write_bytes(body)
            partial.replace(target)
        return pd.DataFrame({"frame_id": [name], "points": [len(pdf)]})

    every.groupBy("frame_id").applyInPandas(write, "frame_id string, points long").collect()
