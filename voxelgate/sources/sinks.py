"""Point clouds and reports to files."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import object_list
from . import files
from .shared import checkpoint


#: The lines of a PCD header, with the number of points to be put in. Fixed values.
PCD_HEAD = ("VERSION .7", "FIELDS x y z", "TYPE F F F", "SIZE 4 4 4", "COUNT 1 1 1", "WIDTH {n}", "HEIGHT 1", "POINTS {n}", "DATA ascii")


def _npy_head(n: int) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (n, 3)})
    return head.getvalue()


def _write_ranges(records: DataFrame, path: str, head: Callable[[int], bytes]) -> None:
    """records (binary record, in the order of partitions and rows) after head, which is given their number, as one file.

    The bytes of each partition are counted first; their sums up to a partition say where its task
    writes. A task that runs again writes the same bytes to the same place. The file gets its name
    when it is whole. The tasks write into one file, so it has to be in a mounted file system.
    """
    system, target, _ = files.located(path)
    if not isinstance(system, LocalFileSystem):
        raise ValueError(f"one file is written by many tasks in mounted file systems only; write a folder to {path}")
    records = checkpoint(records)
    part = F.spark_partition_id()
    sizes = {r["part"]: r for r in records.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("record")).alias("bytes")).collect()}
    start = head(sum(r["n"] for r in sizes.values()))
    begins, end = {}, len(start)
    for p in sorted(sizes):
        begins[p], end = end, end + sizes[p]["bytes"]
    partial = f"{target}.partial"
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    with open(partial, "wb") as f:
        f.write(start)
        f.truncate(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        written = 0
        with open(partial, "r+b") as f:
            f.seek(begins.get(TaskContext.get().partitionId(), 0))
            for batch in batches:
                written += f.write(b"".join(batch.column(0).to_pylist()))
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_pydict({"bytes": [written]})

    done = records.mapInArrow(write, "bytes long").agg(F.sum("bytes")).first()[0] or 0
    if done != end - len(start):
        raise OSError(f"{done} of {end - len(start)} bytes of {path} were written")
    os.replace(partial, target)


def write_packed(rows: DataFrame, path: str, kinds: dict[str, str], head: Callable[[int], bytes] = lambda n: b"") -> None:
    """rows, in their order, as records of numbers of the given types (column to numpy type), after head."""
    kind = np.dtype(list(kinds.items()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.empty(batch.num_rows, kind)
            for i, name in enumerate(kinds):
                data[name] = batch.column(i).to_numpy(zero_copy_only=False)
            plain, width = data.tobytes(), kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([plain[at : at + width] for at in range(0, len(plain), width)], pa.binary())], ["record"])

    _write_ranges(rows.select(*kinds).mapInArrow(pack, "record binary"), path, head)


def write_points(points: DataFrame, path: str, *, fmt: str = "auto", order: str = "point_id") -> None:
    """One file, in the order of point_id: pcd, npy, csv, or text separated by blanks for any other format.

    The tasks write it together, each its own range of bytes; no point passes the driver.
    """
    fmt = PurePosixPath(path).suffix.lower().lstrip(".") if fmt == "auto" else fmt.lower()
    rows = points.orderBy(order).select(*[F.col(a).cast("double").alias(a) for a in "xyz"])
    if fmt in ("npy", "npz"):
        write_packed(rows, path if path.endswith(".npy") else f"{path}.npy", dict.fromkeys("xyz", "<f8"), _npy_head)
        return
    separator = "," if fmt == "csv" else " "
    line = F.concat(F.concat_ws(separator, *[F.printf(F.lit("%.10f"), a) for a in "xyz"]), F.lit("\n"))
    head = (lambda n: ("\n".join(PCD_HEAD) + "\n").format(n=n).encode()) if fmt == "pcd" else (lambda n: (separator.join("xyz") + "\n").encode())
    _write_ranges(rows.select(line.cast("binary").alias("record")), path, head)


def write_points_folder(points: DataFrame, path: str, *, fmt: str = "csv") -> None:
    """A folder of part files, written by the executors; the form for clouds too large for one file."""
    separator = "," if fmt == "csv" else " "
    points.select(F.concat_ws(separator, *[F.printf(F.lit("%.10f"), a) for a in "xyz"]).alias("value")).write.mode("overwrite").text(path)


def write_boxes_folder(boxes: DataFrame, path: str, *, fmt: str = "json", frame: str = "frame_id") -> None:
    """Boxes as a table with a header (csv), or as one JSON document in a folder of its own for each frame."""
    if fmt == "csv":
        sides = {"l": "length", "w": "width", "h": "height"}
        boxes.select("cx", "cy", "cz", *sides, "yaw", "label").withColumnsRenamed(sides).write.mode("overwrite").csv(path, header=True)
        return
    item = F.struct(F.array("cx", "cy", "cz").alias("center"), F.array("l", "w", "h").alias("size"), "yaw", "label")
    boxes.groupBy(frame).agg(F.to_json(F.struct(F.collect_list(item).alias("objects"))).alias("value")).write.mode("overwrite").partitionBy(frame).text(path)


def write_feather_folder(rows: DataFrame, path: str) -> list[str]:
    """A Feather file for each partition, written by the executors into a folder that they share; gives the files' paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder, before = files.located(path)
        system.create_dir(folder, recursive=True)
        target = f"{folder}/part-{context.partitionId():05d}.feather"
        partial = f"{target}.{context.taskAttemptId()}"
        writer = stream = None
        for batch in batches:
            if writer is None:
                stream = system.open_output_stream(partial)
                writer = pa.ipc.new_file(stream, batch.schema)
            writer.write_batch(batch)
        if writer:
            writer.close()
            stream.close()
            system.move(partial, target)
            yield pa.RecordBatch.from_pydict({"path": [before + target]})

    return [r["path"] for r in rows.mapInArrow(write, "path string").collect()]


def summary(totals: DataFrame, boxes: DataFrame) -> dict:
    """Totals (one row, as of operators.crop.summarise) and the objects."""
    listed = object_list(boxes).first()
    return totals.first().asDict() | {"objects": [o.asDict() for o in listed["objects"]] if listed else []}


def write_summary(path: str, report: dict) -> None:
    files.write_whole(path, json.dumps(report, ensure_ascii=False, indent=2).encode())
