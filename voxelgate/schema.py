"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _DOUBLE, _TEXT = T.LongType(), T.DoubleType(), T.StringType()

POINTS = _table(frame_id=_TEXT, point_id=_LONG, x=_DOUBLE, y=_DOUBLE, z=_DOUBLE)
XYZ = _table(point_id=_LONG, x=_DOUBLE, y=_DOUBLE, z=_DOUBLE)
BOX = _table(cx=_DOUBLE, cy=_DOUBLE, cz=_DOUBLE, l=_DOUBLE, w=_DOUBLE, h=_DOUBLE, yaw=_DOUBLE, label=_TEXT)
BOXES = T.StructType([T.StructField("box_id", _LONG), *BOX.fields])
QUATERNION_POSES = _table(timestamp_ns=_LONG, qw=_DOUBLE, qx=_DOUBLE, qy=_DOUBLE, qz=_DOUBLE, tx_m=_DOUBLE, ty_m=_DOUBLE, tz_m=_DOUBLE)
MATRIX = [f"r{i}{j}" for i in range(3) for j in range(3)]
SHIFT = ["tx", "ty", "tz"]
