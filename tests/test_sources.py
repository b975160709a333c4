import json
import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from voxelgate.sources import formats, pointcloud2
from voxelgate.sources.boxes import parse_calibration, read_boxes, read_poses
from voxelgate.sources.points import read_points
from voxelgate.sources.sinks import write_points
from voxelgate.sources.synthetic import CAR_BOX, scene


def xyz(df):
    return [(r.x, r.y, r.z) for r in df.orderBy("point_id").collect()]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("a.csv", "x,y,z\n1,2,3\n4,5,6\n", [(1, 2, 3), (4, 5, 6)]),
        ("a.txt", "1 2 3\n4 5 6\n", [(1, 2, 3), (4, 5, 6)]),
        ("a.xyz", "x y z intensity\n1 2 3 9\n4 5 6 9\n", [(1, 2, 3), (4, 5, 6)]),
        ("b.csv", "intensity,point_z,point_y,point_x\n9,3,2,1\n", [(1, 2, 3)]),
        ("c.txt", "# remark\n1 2 3 # end\n\n", [(1, 2, 3)]),
        ("empty.txt", "", []),
    ],
)
def test_text_points(spark, tmp_path, name, text, want):
    (tmp_path / name).write_text(text)
    assert xyz(read_points(spark, str(tmp_path / name), fmt="auto")) == want


def test_text_errors(spark, tmp_path):
    (tmp_path / "h.csv").write_text("x,y,z\n")
    with pytest.raises(ValueError, match="no line of numbers"):
        read_points(spark, str(tmp_path / "h.csv"), fmt="auto")
    (tmp_path / "s.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="fewer than three numbers"):
        read_points(spark, str(tmp_path / "s.txt"), fmt="text").collect()
    with pytest.raises(ValueError, match="can't be read"):
        read_points(spark, str(tmp_path / "s.txt"), fmt="csv")


def test_tab_before_numbers_is_a_header(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\t2\t3\n4\t5\t6\n")
    assert xyz(read_points(spark, str(tmp_path / "t.txt"), fmt="text")) == [(4, 5, 6)]


def test_npy_and_kitti_and_feather(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(10.0).reshape(2, 5))
    assert xyz(read_points(spark, str(tmp_path / "a.npy"), fmt="auto")) == [(0, 1, 2), (5, 6, 7)]
    np.save(tmp_path / "b.npy", np.arange(3.0))
    assert xyz(read_points(spark, str(tmp_path / "b.npy"), fmt="auto")) == [(0, 1, 2)]
    np.arange(8, dtype="<f4").tofile(tmp_path / "k.bin")
    assert xyz(read_points(spark, str(tmp_path / "k.bin"), fmt="auto")) == [(0, 1, 2), (4, 5, 6)]
    np.arange(5, dtype="<f4").tofile(tmp_path / "bad.bin")
    with pytest.raises(Exception, match="whole record of four floats"):
        read_points(spark, str(tmp_path / "bad.bin"), fmt="auto").collect()
    feather.write_feather(pa.table({"x": [1.0], "y": [2.0], "z": [3.0], "laser": [7]}), tmp_path / "f.feather")
    assert xyz(read_points(spark, str(tmp_path / "f.feather"), fmt="auto")) == [(1, 2, 3)]
    feather.write_feather(pa.table({"x": [1.0], "y": [2.0]}), tmp_path / "g.feather")
    with pytest.raises(Exception, match="has no column z"):
        read_points(spark, str(tmp_path / "g.feather"), fmt="auto").collect()


def _pcd(path, kind, payload, fields="x y z rgb", size="4 4 8 2", types="F F F U", count="1 1 1 2", points=2):
    head = f"# remark\nVERSION .7\nFIELDS {fields}\nSIZE {size}\nTYPE {types}\nCOUNT {count}\nWIDTH {points}\nHEIGHT 1\nPOINTS {points}\nDATA {kind}\n"
    path.write_bytes(head.encode() + payload)


def test_pcd(spark, tmp_path):
    _pcd(tmp_path / "b.pcd", "binary", b"".join(struct.pack("<ffdHH", i, i + 1, i + 2, 7, 8) for i in range(2)))
    assert xyz(read_points(spark, str(tmp_path / "b.pcd"), fmt="auto")) == [(0, 1, 2), (1, 2, 3)]
    _pcd(tmp_path / "a.pcd", "ascii", b"9 1 2 3\n# no\n8 4 5 6\n", "rgb x y z", "4 4 4 4", "U F F F", "1 1 1 1")
    assert xyz(read_points(spark, str(tmp_path / "a.pcd"), fmt="auto")) == [(1, 2, 3), (4, 5, 6)]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"kind": "binary_compressed"}, "kind binary_compressed can't be read"),
        ({"fields": "x y rgb w"}, "no x, y and z among"),
        ({"size": "4 4"}, "as many sizes, types or counts as fields"),
        ({"points": 9}, "ends before its 9 points"),
        ({"types": "F F F Q"}, "no PCD number has type Q"),
    ],
)
def test_pcd_errors(spark, tmp_path, change, message):
    settings = {"kind": "binary", "payload": b"\0" * 40} | change
    _pcd(tmp_path / "b.pcd", **settings)
    with pytest.raises(Exception, match=message):
        read_points(spark, str(tmp_path / "b.pcd"), fmt="auto").collect()


@pytest.mark.parametrize("suffix", ["pcd", "csv", "txt", "npy"])
@pytest.mark.parametrize("rows", [[(0, 1.5, -2.25, 3.125), (1, 4.0, 5.0, 6.0)], []])
def test_round_trip(spark, tmp_path, suffix, rows):
    path = str(tmp_path / f"o.{suffix}")
    write_points(spark.createDataFrame(rows, "point_id long, x double, y double, z double").repartition(3), path)
    if rows or suffix in ("pcd", "npy"):
        assert xyz(read_points(spark, path, fmt="auto")) == [r[1:] for r in rows]
    assert [p.name for p in tmp_path.iterdir()] == [f"o.{suffix}"]


def test_many_tasks_write_one_file(spark, tmp_path):
    """Lines of unlike lengths, some partitions without rows; what the file has is what one writer would have written."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, np.round(10.0 ** rng.integers(-3, 6, 3) * rng.normal(size=3), 6))) for i in range(2000) if i % 500 < 300]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double").repartition(7)
    write_points(points, str(tmp_path / "sub" / "a.npy"))
    assert np.load(tmp_path / "sub" / "a.npy").tolist() == [list(r[1:]) for r in rows]
    lines = "".join(f"{x:.10f} {y:.10f} {z:.10f}\n" for _, x, y, z in rows)
    write_points(points, str(tmp_path / "a.txt"))
    assert (tmp_path / "a.txt").read_text() == "x y z\n" + lines
    write_points(points, f"file:{tmp_path}/a.pcd")
    head, body = (tmp_path / "a.pcd").read_text().split("DATA ascii\n")
    assert body == lines and f"POINTS {len(rows)}\n" in head
    # over what was there, which was longer
    write_points(points.limit(1), str(tmp_path / "a.txt"))
    assert (tmp_path / "a.txt").read_text().count("\n") == 2
    with pytest.raises(ValueError, match="write a folder"):
        write_points(points, "mock:///x/a.npy")


def test_lines_at_the_ends_of_ranges(spark, tmp_path, monkeypatch):
    """However a file of lines is cut, each line is read once, with its own place."""
    from voxelgate.sources import formats

    lines = [f"{i} {i}.5 -{i}e1" + " " * (i % 5) for i in range(300)] + ["", "# no", "7 8 9"]
    _pcd(tmp_path / "l.pcd", "ascii", "\n".join(lines).encode(), "x y z", "4 4 4", "F F F", "1 1 1", 301)
    reader = formats._PcdReader({"path": str(tmp_path / "l.pcd")})
    whole = None
    for size in (1 << 20, 1, 7, 64, 1000):
        monkeypatch.setattr(formats, "_BYTES", size)
        got = [(i, x, y, z) for part in reader.partitions() for b in reader.read(part) for i, x, y, z in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
        whole = whole or got
        assert got == whole and len(got) == 301 and got[-1][1:] == (7, 8, 9)


def test_other_ways_to_name_files(spark, tmp_path):
    """A scheme before the path, a pattern, a folder; arrays stored by columns."""
    np.save(tmp_path / "a.npy", np.asfortranarray(np.arange(12.0).reshape(3, 4)))
    np.save(tmp_path / "b.npy", np.arange(6, dtype="<i4").reshape(2, 3))
    want = [(0, 1, 2), (4, 5, 6), (8, 9, 10)]
    assert xyz(read_points(spark, f"file://{tmp_path}/a.npy", fmt="auto")) == want
    assert sorted(xyz(read_points(spark, f"file:{tmp_path}/*.npy", fmt="npy"))) == sorted([*want, (0, 1, 2), (3, 4, 5)])
    paths = {r.path for r in read_points(spark, f"file://{tmp_path}", fmt="npy").select("path").collect()}
    assert paths == {f"file://{tmp_path}/a.npy", f"file://{tmp_path}/b.npy"}
    with pytest.raises(Exception, match="nothing to read"):
        read_points(spark, f"{tmp_path}/*.none", fmt="npy").collect()


def test_batches_are_skipped_by_timestamp(spark, tmp_path):
    """Of batches that can't hold the timestamp only that column is read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull
    from pyspark.sql.types import StructType

    from voxelgate.sources import formats

    path = str(tmp_path / "t.feather")
    with pa.ipc.new_file(path, pa.schema([("timestamp_ns", pa.int64()), ("x", pa.float64())])) as f:
        for i in range(4):
            f.write_batch(pa.record_batch({"timestamp_ns": pa.array([10 * i, 10 * i + 1] if i < 3 else [None, None], pa.int64()), "x": [float(i), i + 0.5]}))
    schema = StructType.fromDDL("row_no long, timestamp_ns long, x double")
    reader = formats._FilteringFeatherReader({"path": path}, schema)
    assert len(list(reader.pushFilters([EqualTo(("timestamp_ns",), 11), IsNull(("x",))]))) == 2
    assert [b.column("x").to_pylist() for part in reader.partitions() for b in reader.read(part)] == [[1.0, 1.5]]
    late = formats._FilteringFeatherReader({"path": path}, schema)
    late.pushFilters([GreaterThan(("timestamp_ns",), 1)])
    assert sum(b.num_rows for part in late.partitions() for b in late.read(part)) == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = formats.read_feather(spark, path, "row_no long, timestamp_ns long, x double").filter("timestamp_ns = 11")
        assert [tuple(r) for r in rows.collect()] == [(3, 11, 1.5)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_json_boxes(spark, tmp_path):
    good = {"center": [1, 2, 3], "size": [4, 5, 6]}
    (tmp_path / "b.json").write_text(json.dumps({"objects": [good, {"center": [1, 2]}, {"position": {"x": 1, "y": 2, "z": "3"}, "length": 1, "width": 2, "height": 3, "yaw_deg": 180, "label": "car"}]}))
    rows = read_boxes(spark, str(tmp_path / "b.json"), skip_invalid=True).orderBy("box_id").collect()
    assert [(r.cx, r.l, r.yaw, r.label) for r in rows] == [(1, 4, 0, None), (1, 1, math.pi, "car")]
    with pytest.raises(Exception, match="this entry is no box"):
        read_boxes(spark, str(tmp_path / "b.json")).collect()


def test_csv_boxes(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Center_X,cy,z,Length,w,height,yaw,label\n1,2,3,4,5,6,0.5,a\n1,2,3,0,5,6,0.5,b\n,2,3,4,5,6,0,c\n")
    rows = read_boxes(spark, str(tmp_path / "b.csv"), skip_invalid=True).collect()
    assert [(r.cx, r.cy, r.l, r.yaw, r.label) for r in rows] == [(1, 2, 4, 0.5, "a")]
    with pytest.raises(Exception, match="no box in this row"):
        read_boxes(spark, str(tmp_path / "b.csv")).collect()


CALIB = "P0: 1\nTr_velo_to_cam: 0 -1 0 0 0 0 -1 0 1 0 0 0\n"


def test_kitti_boxes(spark, tmp_path):
    line = "{} 0 0 0 0 0 0 0 1.5 1.8 4.5 2.0 1.25 10.0 0.3"
    (tmp_path / "l.txt").write_text("\n".join(line.format(k) for k in ("Car", "DontCare", "Misc")) + "\n")
    (tmp_path / "c.txt").write_text(CALIB)
    (r,) = read_boxes(spark, str(tmp_path / "l.txt"), fmt="kitti", calib_path=str(tmp_path / "c.txt")).collect()
    assert (r.cx, r.cy, r.cz) == pytest.approx((10, -2, -0.5)) and (r.l, r.w, r.h, r.label) == (4.5, 1.8, 1.5, "Car")
    (plain,) = read_boxes(spark, str(tmp_path / "l.txt"), fmt="kitti").collect()
    assert (plain.cx, plain.cy, plain.cz) == pytest.approx((10, -2, -0.5)) and plain.yaw == pytest.approx(-(0.3 + math.pi / 2))
    (tmp_path / "s.txt").write_text("Car 1 2\n")
    with pytest.raises(Exception, match="needs 15 fields"):
        read_boxes(spark, str(tmp_path / "s.txt"), fmt="kitti").collect()
    assert read_boxes(spark, str(tmp_path / "s.txt"), fmt="kitti", skip_invalid=True).count() == 0


def test_calibration():
    assert (parse_calibration(CALIB.splitlines()) @ [0, 0, 1, 1])[:3] == pytest.approx([1, 0, 0])
    with pytest.raises(ValueError, match="gives Tr_velo_to_cam"):
        parse_calibration(["P0: 1"])


def test_av2_boxes_and_poses(spark, tmp_path):
    n = {c: [1.0, 2.0] for c in ("length_m", "width_m", "height_m")} | {"qw": [1.0, math.sqrt(0.5)], "qx": [0.0, 0.0], "qy": [0.0, 0.0], "qz": [0.0, math.sqrt(0.5)], "tx_m": [1.0, 9.0], "ty_m": [1.0, 8.0], "tz_m": [1.0, 7.0]}
    feather.write_feather(pa.table({"timestamp_ns": [100, 200], "category": ["A", "B"]} | n), tmp_path / "a.feather")
    (r,) = read_boxes(spark, str(tmp_path / "a.feather"), timestamp_ns=200).collect()
    assert (r.cx, r.cy, r.cz, r.label) == (9, 8, 7, "B") and r.yaw == pytest.approx(math.pi / 2)
    with pytest.warns(UserWarning, match="2 timestamps"):
        assert read_boxes(spark, str(tmp_path / "a.feather")).count() == 2
    pose = {"timestamp_ns": [200, 200], "qw": [1.0, math.sqrt(0.5)], "qx": [0.0, 0.0], "qy": [0.0, 0.0], "qz": [0.0, math.sqrt(0.5)], "tx_m": [0.0, 10.0], "ty_m": [0.0, 20.0], "tz_m": [0.0, 30.0]}
    feather.write_feather(pa.table(pose), tmp_path / "p.feather")
    (p,) = read_poses(spark, str(tmp_path / "p.feather")).collect()
    assert (p.tx, p.ty, p.tz) == (10, 20, 30) and (p.r00, p.r10) == pytest.approx((0, 1))
    with pytest.raises(ValueError, match="from .feather files"):
        read_poses(spark, "p.csv")


def test_point_messages(spark):
    points = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 5.0, 6.0), ("b", 0, 7.0, 8.0, 9.0)], "frame_id string, point_id long, x double, y double, z double")
    frames = spark.createDataFrame([("a",), ("b",), ("c",)], "frame_id string")
    sent = pointcloud2.encode(points, frames)
    assert {r.frame_id: r.width for r in sent.collect()} == {"a": 2, "b": 1, "c": 0}
    assert sorted(pointcloud2.decode(sent).collect()) == sorted(points.collect())
    big = struct.pack(">dhi", 1.5, 2, 3)
    fields = [{"name": n, "offset": o, "datatype": t, "count": 1} for n, o, t in (("x", 0, 8), ("y", 8, 3), ("z", 10, 5))]
    assert pointcloud2.unpack(1, 1, 14, True, fields, big).tolist() == [[1.5, 2, 3]]
    with pytest.raises(ValueError, match="needs fields x, y and z"):
        pointcloud2.unpack(1, 1, 14, True, fields[:2], big)


def test_synthetic_scene(spark):
    from voxelgate.operators.crop import mark_points

    points = scene(spark)
    box = spark.createDataFrame([("000000", *CAR_BOX.values())], "frame_id string, cx double, cy double, cz double, l double, w double, h double, yaw double, label string")
    removed = mark_points(points, box).filter(~F.col("keep")).count()
    assert points.count() == 5500 and 500 <= removed < 700


def test_messages_are_packed_in_parts(spark):
    """No worker gets a whole frame: its points are packed part by part, and the message has them in order."""
    n = 30_000
    points = spark.range(n).selectExpr("'a' AS frame_id", f"{n} - 1 - id AS point_id", "CAST(id AS DOUBLE) AS x", "1.0D AS y", "2.0D AS z").repartition(3)
    most = spark.sparkContext.accumulator([], pointcloud2_sizes())

    def pack(frame, part):
        most.add([len(part)])
        return part[["x", "y", "z"]].to_numpy().astype("<f4").tobytes()

    sent = pointcloud2.gather(points, "point_id", pack).collect()
    assert [(r.frame_id, r.width, len(r.data)) for r in sent] == [("a", n, 12 * n)] and max(most.value) <= 10_000
    got = pointcloud2.unpack(n, 1, 12, False, [{"name": a, "offset": 4 * i, "datatype": 7, "count": 1} for i, a in enumerate("xyz")], sent[0].data)
    assert got[:, 0].tolist() == [float(i) for i in reversed(range(n))]
    assert sorted(tuple(r) for r in pointcloud2.decode(pointcloud2.encode(points)).select("point_id", "x").collect()) == [(i, float(n - 1 - i)) for i in range(n)]


def pointcloud2_sizes():
    from pyspark.accumulators import AccumulatorParam

    class Sizes(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, a, b):
            return a + b

    return Sizes()


def test_lines_of_text_stay_where_they_are_read(spark, tmp_path):
    """Lines of one file don't meet in one task, and their texts aren't sorted by file."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("z,y,x\n" * (i > 0) + "".join(f"{i},{j},{j * i}\n" for j in range(50)))
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        rows = read_points(spark, f"{tmp_path}/*.csv", fmt="auto")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set(name, before)
    assert sorted((r.x, r.y) for r in rows.filter("path LIKE '%0.csv'").collect()) == [(0.0, float(j)) for j in range(50)]


def test_binary_records_are_read_block_by_block(tmp_path, monkeypatch):
    n, kind = 3 * formats._BLOCK + 5, np.dtype([("x", "<f8"), ("other", "<f8", (9,)), ("y", "<f4"), ("z", "<i4")])
    data = np.zeros(n, kind)
    data["x"], data["y"], data["z"] = np.arange(n), np.arange(n) % 7, -np.arange(n)
    path = tmp_path / "a.pcd"
    path.write_bytes(f"FIELDS x other y z\nSIZE 8 8 4 4\nTYPE F F F I\nCOUNT 1 9 1 1\nPOINTS {n}\nDATA binary\n".encode() + data.tobytes())
    read, lengths = formats._piece, []
    monkeypatch.setattr(formats, "_piece", lambda p, start, length: lengths.append(length) or read(p, start, length))
    got = pa.Table.from_batches(formats._PcdReader({"path": str(path)}).rows(formats.FileRange(str(path), 2, n - 2)))
    assert max(lengths) <= formats._BLOCK * kind.itemsize
    assert got["point_id"].to_pylist() == list(range(2, n))
    assert all((got[a].to_numpy() == data[a][2:]).all() for a in "xyz")
