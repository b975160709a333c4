"""Packed point-cloud messages to rows and back.

A cloud is one message, or comes in parts: a head, which is part 0, and messages of at most PART
points, which are numbered upwards in the order of the points. All have the cloud's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scalar types of message fields by their number. Fixed values.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
MESSAGE = "frame_id string, width int, height int, point_step int, is_bigendian boolean, fields array<struct<name:string,offset:int,datatype:int,count:int>>, data binary"


#: The columns of a packed cloud besides its name.
FIELDS = ("width", "height", "point_step", "is_bigendian", "fields", "data")


#: The fields of a cloud of three 32-bit floats.
_PLAIN = "array(" + ", ".join(f"named_struct('name', '{a}', 'offset', {4 * i}, 'datatype', 7, 'count', 1)" for i, a in enumerate("xyz")) + ")"
#: Points of a message that are read at once, and those of one part of a cloud.
SLICE, PART = 1 << 16, 1 << 18


def _records(width: int, height: int, step: int, big: bool, fields: list, data: bytes | pa.Buffer) -> np.ndarray:
    """The points of one message as records that lie in its data; without width or height there are none."""
    if width <= 0 or height <= 0:
        return np.zeros(0, [(a, "f8") for a in "xyz"])
    by_name = {f["name"]: f for f in fields}
    missing = [a for a in "xyz" if a not in by_name]
    if missing:
        raise ValueError(f"a packed cloud needs fields x, y and z; {', '.join(missing)} is missing")
    parts = {"names": [], "formats": [], "offsets": [], "itemsize": step}
    for a in "xyz":
        f = by_name[a]
        if f["count"] != 1:
            raise ValueError(f"field {a} of a packed cloud has {f['count']} values, not one")
        if f["datatype"] not in FIELD_TYPES:
            raise ValueError(f"no number of a packed cloud has type {f['datatype']}")
        parts["names"].append(a)
        parts["formats"].append((">" if big else "<") + FIELD_TYPES[f["datatype"]])
        parts["offsets"].append(f["offset"])
    n = width * height
    if len(data) < n * step:
        raise ValueError(f"a packed cloud of {n} points ends before the last")
    return np.frombuffer(data, np.dtype(parts), n)


def unpack(width: int, height: int, step: int, big: bool, fields: list, data: bytes) -> np.ndarray:
    """The x, y, z of one message."""
    got = _records(width, height, step, big, fields, data)
    return np.stack([got[a].astype(np.float64) for a in "xyz"], axis=1)


def decode(messages: DataFrame) -> DataFrame:
    """Messages (MESSAGE) to frame_id, point_id, x, y, z, and part if they have it; a point_id counts within a message."""
    names = [c for c in ("frame_id", "part") if c in messages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = {c: batch.column(c)[i] for c in (*names, *FIELDS)}
                got = _records(*[m[c].as_py() for c in FIELDS[:-1]], m["data"].as_buffer())
                for at in range(0, len(got), SLICE):
                    part = got[at : at + SLICE]
                    yield pa.record_batch({**{c: pa.repeat(m[c], len(part)) for c in names}, "point_id": pa.array(np.arange(at, at + len(part))), **{a: pa.array(part[a].astype(np.float64)) for a in "xyz"}})

    kinds = {"frame_id": "string", "part": "long"}
    return messages.select(*names, *FIELDS).mapInArrow(run, f"{', '.join(f'{c} {kinds[c]}' for c in names)}, point_id long, x double, y double, z double")


def gather(points: DataFrame, order: str, pack: Callable[[object, pd.DataFrame], bytes]) -> DataFrame:
    """frame_id, width and data of each frame: the bytes that pack makes of its points by order.

    pack gets a frame's id and some of its points at a time; only bytes meet in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            runs, rows, at = pc.run_end_encode(batch.column("frame_id")), batch.drop_columns(["frame_id"]).to_pandas(), 0
            for end, frame in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                part, at = rows.iloc[at:end], end
                yield pa.record_batch({"frame_id": pa.array([frame], batch.schema.field("frame_id").type), "place": pa.array([place]), "n": pa.array([len(part)], pa.int64()), "part": pa.array([pack(frame, part)], pa.binary())})
                place += 1

    kind = points.schema["frame_id"].dataType.simpleString()
    dealt = points.repartitionByRange("frame_id", order).sortWithinPartitions("frame_id", order)
    parts = dealt.mapInArrow(run, f"frame_id {kind}, place long, n long, part binary")
    return parts.groupBy("frame_id").agg(F.sum("n").cast("int").alias("width"), F.expr("listagg(part) WITHIN GROUP (ORDER BY place)").alias("data"))


def encode(points: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One message for each frame, with x, y, z as 32-bit floats. frames (frame_id) adds those without points."""
    pack = lambda _, part: part[["x", "y", "z"]].to_numpy().astype("<f4").tobytes()
    sent = gather(points.select("frame_id", "point_id", "x", "y", "z"), "point_id", pack)
    out = sent.selectExpr("CAST(frame_id AS STRING) AS frame_id", "width", "1 AS height", "12 AS point_step", "false AS is_bigendian", f"{_PLAIN} AS fields", "data")
    if frames is None:
        return out
    bare = frames.select("frame_id").distinct().join(out, "frame_id", "left_anti")
    empty = bare.selectExpr("frame_id", "0 AS width", "1 AS height", "12 AS point_step", "false AS is_bigendian", f"{_PLAIN} AS fields", "X'' AS data")
    return out.unionByName(empty)


def _pack_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points by frame_id and, if they have it, part: a message for each of them, or of PART points at most, which are numbered."""
    place, name, part, held, size = (TaskContext.get().partitionId() << 32) + 1, None, None, [], 0

    def message() -> pa.RecordBatch:
        return pa.record_batch({"frame_id": [name], "part": pa.array([place if part is None else part], pa.int64()), "width": pa.array([size], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})

    for batch in batches:
        keys = [batch.column(c) for c in ("frame_id", "part") if c in batch.schema.names]
        ends = sorted({e for k in keys for e in pc.run_end_encode(k).run_ends.to_pylist()})
        points, at = np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype("<f4") for a in "xyz"], axis=1), 0
        for end in ends:
            now = [k[at].as_py() for k in keys]
            while at < end:
                if size and (now != [name, part][: len(now)] or (len(now) == 1 and size == PART)):
                    yield message()
                    place, held, size = place + 1, [], 0
                name, part = (*now, None)[:2]
                stop = end if len(now) == 2 else min(end, at + PART - size)
                held.append(points[at:stop].tobytes())
                size, at = size + stop - at, stop
    if size:
        yield message()


def _messages(packed: DataFrame, *more: str) -> DataFrame:
    return packed.selectExpr("frame_id", *more, "width", "1 AS height", "12 AS point_step", "false AS is_bigendian", f"{_PLAIN} AS fields", "data")


_PACKED = "frame_id string, part long, width int, data binary"


def encode_parts(points: DataFrame, frames: DataFrame) -> DataFrame:
    """As encode, with clouds in parts: a column part, and a head without points for each of frames (frame_id).

    points with a column part keep it; points without one are cut in the order of point_id. No
    place holds more than a part.
    """
    given = [c for c in ("part",) if c in points.columns]
    rows = points.select(F.col("frame_id").cast("string").alias("frame_id"), *given, "point_id", "x", "y", "z")
    dealt = rows.repartition("frame_id", "part") if given else rows.repartitionByRange("frame_id", "point_id")
    packed = dealt.sortWithinPartitions("frame_id", *given, "point_id").drop("point_id").mapInArrow(_pack_runs, _PACKED)
    heads = frames.select(F.col("frame_id").cast("string").alias("frame_id")).distinct().selectExpr("frame_id", "0L AS part", "0 AS width", "X'' AS data")
    return _messages(packed.unionByName(heads), "part")


def join_parts(parts: DataFrame) -> DataFrame:
    """Clouds in parts, as of encode_parts, as one message each."""
    return _messages(parts.groupBy("frame_id").agg(F.sum("width").cast("int").alias("width"), F.expr("listagg(data) WITHIN GROUP (ORDER BY part)").alias("data")))
