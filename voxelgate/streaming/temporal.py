"""The persistence filter on a stream, spread over buckets of voxels.

Two stateful steps follow each other. A streaming aggregation counts the points of each frame
until the event-time watermark passes the frame's stamp, which closes it; the closed frame is then
told to every bucket of its sensor. The second step is keyed by sensor and bucket: it holds the
points of open frames as they come, in any order and over any number of micro-batches, and the
voxels of the last closed frames. One sensor so keeps all tasks busy, and the state of a bucket is
bounded by the window and by what is still open.

Points are packed before they are shuffled, many to a row, and are held and closed in pieces of
bounded size, so a task's memory has the voxels of a bucket's window but not its points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import with_voxels
from ..operators.temporal import CELL, MIN_HITS, VOXEL_SIZE, WINDOW_SIZE, check_settings

OUTPUT = "sensor string, frame_seq long, point_id long, x double, y double, z double, keep boolean"
#: Buckets of a sensor's voxels; a closed frame is told to each of them.
BUCKETS = 64
_POINT = np.dtype([("point_id", "<i8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")])
_GROUP = ["sensor", "frame_seq", "bucket"]
#: Points that are packed at a time.
_PACKED = 131_072
#: Bytes of points in one value of the state (65,536 points), and those that a bucket gathers before it puts them there.
_PIECE, _GATHERED = 1 << 21, 1 << 24
#: Voxels that are gathered, at least, before they are made distinct.
_VOXELS = 262_144


def cells_of(xyz: np.ndarray, size: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        cells = np.floor(xyz / size)
    return np.where(np.isfinite(cells), cells, float(-(1 << 63))).astype(np.int64)


def pack(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Points (sensor, frame_seq, bucket, point_id, x, y, z) as one row for each group, batch by batch."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= _PACKED:
            yield _pack(pd.concat(held, ignore_index=True))
            held, size = [], 0
    if size:
        yield _pack(pd.concat(held, ignore_index=True))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    points = np.empty(len(rows), _POINT)
    for name in _POINT.names:
        points[name] = rows[name]
    number = rows.groupby(_GROUP, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(number, kind="stable")
    starts = np.flatnonzero(np.diff(number[order], prepend=-1))
    return rows[_GROUP].iloc[order[starts]].assign(points=[p.tobytes() for p in np.split(points[order], starts[1:])])


class PersistenceWindow:
    """Hit counts over the last frames. A frame without points moves the window only where it is told that others have some."""

    def __init__(self, voxel_size: float, window_size: int, min_hits: int, frames: list[bytes] | None = None):
        check_settings(voxel_size, window_size, min_hits)
        self.voxel_size, self.window_size, self.min_hits = voxel_size, window_size, min_hits
        self.frames = list(frames or [])

    def push(self, xyz: np.ndarray, part: bool = False) -> np.ndarray:
        """Whether each point of the next frame stays; part: these are the points of one bucket of it."""
        if not len(xyz) and not part:
            return np.ones(0, bool)
        self.add([xyz])
        return self.keep(xyz)

    def add(self, pieces: Iterable[np.ndarray]) -> None:
        """Moves the window by the next frame, whose points come in pieces."""
        found, fresh = [np.empty(0, "S24")], 0
        for xyz in pieces:
            found.append(np.unique(self._voxels(xyz)))
            fresh += len(found[-1])
            if fresh > max(_VOXELS, len(found[0])):
                found, fresh = [np.unique(np.concatenate(found))], 0
        cells = np.unique(np.concatenate(found))
        self.frames = [*self.frames, cells.tobytes()][-self.window_size :]
        every, hits = np.unique(np.concatenate([np.frombuffer(f, "S24") for f in self.frames]), return_counts=True)
        self.staying = cells[hits[np.searchsorted(every, cells)] >= self.min_hits]

    def keep(self, xyz: np.ndarray) -> np.ndarray:
        """Whether each of some points of the last frame stays."""
        if not len(self.staying):
            return np.zeros(len(xyz), bool)
        voxels = self._voxels(xyz)
        at = np.searchsorted(self.staying, voxels)
        return self.staying[np.minimum(at, len(self.staying) - 1)] == voxels

    def _voxels(self, xyz: np.ndarray) -> np.ndarray:
        """A text of 24 bytes for each point's voxel, as one column sorts faster than three."""
        return np.ascontiguousarray(cells_of(xyz, self.voxel_size)).view("S24").ravel()


class PersistenceProcessor(StatefulProcessor):
    """One bucket of one sensor: points of open frames by frame, and the voxels of the last closed frames by frame.

    A frame's points lie in whole pieces, which are numbered, and what is less than a piece is with
    their number.
    """

    def __init__(self, voxel_size: float, window_size: int, min_hits: int):
        self.settings = (voxel_size, window_size, min_hits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "frame_seq long", "pieces long, points binary")
        self.whole = handle.getMapState("whole", "frame_seq long, piece long", "points binary")
        self.seen = handle.getMapState("seen", "frame_seq long", "cells binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted(k[0] for k in self.seen.keys())
        last = seen[-1] if seen else None
        came, closing, size = {}, set(), 0
        for part in rows:
            for frame, points in zip(part["frame_seq"].tolist(), part["points"], strict=True):
                # what comes after its frame was closed is too late
                if last is not None and frame <= last:
                    continue
                if points is None:
                    closing.add(frame)
                    continue
                came.setdefault(frame, []).append(points)
                size += len(points)
                if size >= _GATHERED:
                    self._hold(came)
                    came, size = {}, 0
        closing = sorted(closing)
        if closing:
            window = PersistenceWindow(*self.settings, frames=[bytes(self.seen.getValue((f,))[0]) for f in seen])
            for frame in closing:
                fresh = b"".join(came.pop(frame, []))
                window.add(np.stack([points[a] for a in "xyz"], axis=1) for points in self._pieces(frame, fresh))
                for points in self._pieces(frame, fresh):
                    keep = window.keep(np.stack([points[a] for a in "xyz"], axis=1))
                    yield pd.DataFrame({"sensor": key[0], "frame_seq": frame, **{n: points[n] for n in _POINT.names}, "keep": keep})
            every = [*seen, *closing]
            for frame, cells in zip(closing[-len(window.frames) :], window.frames[-len(closing) :], strict=True):
                self.seen.updateValue((frame,), (cells,))
            for frame in set(seen) - set(every[-len(window.frames) :]):
                self.seen.removeKey((frame,))
            # frames that were passed over have no more to wait for
            for frame in [k[0] for k in self.open.keys()]:
                if frame <= closing[-1]:
                    for n in range(self._held(frame)[0]):
                        self.whole.removeKey((frame, n))
                    self.open.removeKey((frame,))
            came = {f: p for f, p in came.items() if f > closing[-1]}
        self._hold(came)

    def _held(self, frame: int) -> tuple[int, bytes]:
        """The number of an open frame's whole pieces, and what is less than a piece."""
        if not self.open.containsKey((frame,)):
            return 0, b""
        pieces, rest = self.open.getValue((frame,))
        return pieces, bytes(rest)

    def _hold(self, came: dict[int, list[bytes]]) -> None:
        for frame, fresh in came.items():
            pieces, rest = self._held(frame)
            data = b"".join([rest, *fresh])
            whole = len(data) // _PIECE
            for n in range(whole):
                self.whole.updateValue((frame, pieces + n), (data[n * _PIECE : (n + 1) * _PIECE],))
            self.open.updateValue((frame,), (pieces + whole, data[whole * _PIECE :]))

    def _pieces(self, frame: int, fresh: bytes) -> Iterator[np.ndarray]:
        """The points of a frame that is open, and those that came for it now."""
        pieces, rest = self._held(frame)
        for n in range(pieces):
            yield np.frombuffer(bytes(self.whole.getValue((frame, n))[0]), _POINT)
        data = rest + fresh
        for at in range(0, len(data), _PIECE):
            yield np.frombuffer(data[at : at + _PIECE], _POINT)

    def close(self) -> None:
        pass


def filter_stream(points: DataFrame, voxel_size: float = VOXEL_SIZE, window_size: int = WINDOW_SIZE, min_hits: int = MIN_HITS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of points (sensor, frame_seq, point_id, x, y, z and, if they have one, the timestamp stamp of their frame) with a column keep.

    A frame comes out once the watermark, the largest stamp so far less late, has reached its
    stamp; until then its points may come in any order and in any number of micro-batches. Without
    a column stamp a frame's number (0 or more) counts as its second. Stamps are later than 1970,
    as the watermark begins there, and rise with frame_seq. Rows with a
    null point_id are no points; one with a later stamp closes the frames before it. Points that
    come after their frame was closed are dropped. Needs the RocksDB state store.
    """
    check_settings(voxel_size, window_size, min_hits)
    stamp = F.col("stamp") if "stamp" in points.columns else F.timestamp_seconds(F.col("frame_seq") + 1)
    rows = points.select("sensor", "frame_seq", "point_id", "x", "y", "z", stamp.alias("stamp")).withWatermark("stamp", late)
    frames = rows.groupBy("sensor", "frame_seq", "stamp").agg(F.count("point_id").alias("n")).filter("n > 0")
    closed = frames.select("sensor", "frame_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), F.lit(None).cast("binary").alias("points"))
    placed = with_voxels(rows.filter("point_id IS NOT NULL AND frame_seq IS NOT NULL"), voxel_size)
    placed = placed.select("sensor", "frame_seq", F.pmod(F.xxhash64(*CELL), F.lit(buckets)).cast("long").alias("bucket"), *[F.col(n).cast(t) for n, t in (("point_id", "long"), ("x", "double"), ("y", "double"), ("z", "double"))])
    packed = placed.mapInPandas(pack, "sensor string, frame_seq long, bucket long, points binary")
    processor = PersistenceProcessor(voxel_size, window_size, min_hits)
    return packed.unionByName(closed).groupBy("sensor", "bucket").transformWithStateInPandas(processor, OUTPUT, "append", "none")


def closing_row(points: DataFrame) -> DataFrame:
    """A row that closes all frames of a table of points that is read as a stream, as it has no later one."""
    ends = points.agg(F.max("sensor").alias("sensor"), (F.max("frame_seq") + 1).alias("frame_seq")).filter("frame_seq IS NOT NULL")
    return ends.select([F.col(f.name) if f.name in ("sensor", "frame_seq") else F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema.fields])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
