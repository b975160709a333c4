import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgate.functions.geometry import quaternion_matrix, voxel
from voxelgate.operators import accumulate as acc
from voxelgate.operators import align, clusters, crop, frames, temporal
from voxelgate.operators.temporal import keep_persistent
from voxelgate.sources.boxes import poses_from_quaternions

POINTS = "frame_id int, point_id long, x double, y double, z double"
BOXES = "frame_id int, box_id long, cx double, cy double, cz double, l double, w double, h double, yaw double, label string"


def cloud(spark, rng, frames_=3, n=400, spread=6.0):
    rows = [(f, i, *map(float, rng.uniform(-spread, spread, 3))) for f in range(frames_) for i in range(n)]
    return rows, spark.createDataFrame(rows, POINTS)


def brute_crop(rows, boxes, margin):
    kept = []
    for f, i, *p in rows:
        inside = False
        for bf, _, cx, cy, cz, l, w, h, yaw, _ in boxes:
            half = [s / 2 + m for s, m in zip((l, w, h), margin, strict=True)]
            if bf != f or min(half) <= 0:
                continue
            dx, dy, dz = p[0] - cx, p[1] - cy, p[2] - cz
            c, s = math.cos(yaw), math.sin(yaw)
            inside |= abs(c * dx + s * dy) <= half[0] and abs(c * dy - s * dx) <= half[1] and abs(dz) <= half[2]
        if not inside:
            kept.append((f, i))
    return kept


@pytest.mark.parametrize("margin", [(0.05, 0.05, 0.05), (0.0, 0.0, 0.0), (0.5, 0.2, 0.1), (-1.0, 0.0, 0.0)])
def test_crop_equals_brute_force(spark, margin):
    rng = np.random.default_rng(5)
    rows, points = cloud(spark, rng)
    given = [(int(rng.integers(0, 3)), k, *map(float, rng.uniform(-5, 5, 3)), *map(float, rng.uniform(0.5, 5, 3)), float(rng.uniform(-4, 4)), "b") for k in range(12)] + [(0, 99, 0.0, 0.0, 0.0, float("nan"), 1.0, 1.0, 0.0, None)]
    boxes = spark.createDataFrame(given, BOXES)
    want = brute_crop(rows, given[:-1], margin)
    key = lambda df: sorted((r.frame_id, r.point_id) for r in df.collect())
    kept = crop.remove_points(points, boxes, margin)
    assert key(kept) == want
    assert key(crop.remove_points(points, boxes, margin, cell=1.7)) == want
    assert key(crop.mark_points(points, boxes, margin).filter("keep")) == want
    assert crop.points_in_boxes(points, boxes, margin).count() + len(want) == len(rows)


def test_crop_plan_has_an_equi_anti_join_and_no_python(spark):
    rng = np.random.default_rng(1)
    _, points = cloud(spark, rng, n=5)
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, None)], BOXES)
    plan = crop.remove_points(points, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "NestedLoop" not in plan and "Python" not in plan


def test_crop_shuffles_points_once_and_never_by_frame_alone(spark, monkeypatch):
    """With broadcasts off, whether or not there are boxes of any size: the points move once, by frame and cell; for large boxes their distinct cells move too."""
    rng = np.random.default_rng(1)
    rows, points = cloud(spark, rng, n=20)
    given = [(0, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, None), (1, 2, 0.0, 0.0, 0.0, 500.0, 3.0, 3.0, 0.7, None), (2, 3, 1.0, 1.0, 0.0, 1e15, 1e15, 1.0, 0.0, None)]
    monkeypatch.setattr(crop, "BROADCAST_ROWS", -1)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1, 3):
            for made in (crop.remove_points(points, spark.createDataFrame(given[:n], BOXES)), crop.mark_points(points, spark.createDataFrame(given[:n], BOXES))):
                dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", made._jdf.queryExecution().executedPlan().toString())
                by = [[re.sub(r"#\d+L?", "", x.strip()) for x in d.split(",")[:-1]] for d in dealt]
                with_points = [b for b in by if any(c in ("_px", "_point_gx") for c in b)]
                assert len(with_points) == 1 and all(len(b) >= 3 for b in by)
            want = brute_crop(rows, given[:n], crop.MARGIN)
            assert sorted((r.frame_id, r.point_id) for r in crop.remove_points(points, spark.createDataFrame(given[:n], BOXES)).collect()) == want
    finally:
        for k, value in held.items():
            spark.conf.set(k, value)


def test_crop_faces_rotation_and_empty_sides(spark):
    points = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 1.0000001, 0.0, 0.0)], POINTS)
    box = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0, None)], BOXES)
    assert [r.point_id for r in crop.remove_points(points, box, (0, 0, 0)).collect()] == [1]
    turned = spark.createDataFrame([(0, 0, 0.6, 0.0, 0.0), (0, 1, 0.0, 0.6, 0.0)], POINTS)
    for yaw, left in ((0.0, 1), (math.pi / 2, 0)):
        box = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 2.0, 0.2, 2.0, yaw, None)], BOXES)
        assert [r.point_id for r in crop.remove_points(turned, box, (0, 0, 0)).collect()] == [left]
    assert crop.remove_points(points, box.limit(0)).count() == 2 and crop.remove_points(points.limit(0), box).count() == 0
    with pytest.raises(ValueError, match="3 elements"):
        crop.remove_points(points, box, (0.1, 0.1))
    assert crop.summarise(crop.mark_points(points.limit(0), box)).first().asDict() == {"total_points": 0, "kept_points": 0, "removed_points": 0, "removed_ratio": 0.0}


def test_margin_only_removes_more(spark):
    rows, points = cloud(spark, np.random.default_rng(2))
    boxes = spark.createDataFrame([(f, f, 0.0, 0.0, 0.0, 4.0, 3.0, 4.0, 0.7, None) for f in range(3)], BOXES)
    counts = [crop.remove_points(points, boxes, (m, m, m)).count() for m in (0.0, 0.2, 1.0)]
    assert counts == sorted(counts, reverse=True) and counts[0] < len(rows)


def test_small_boxes(spark):
    sizes = spark.createDataFrame([(1.0, 1.0, 1.0), (0.5, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "l double, w double, h double")
    assert crop.drop_small_boxes(sizes, 0.6).count() == 1 and crop.drop_small_boxes(sizes, 0).count() == 3


A, B = (0.5, 0.5, 0.5), (5.5, 5.5, 5.5)


@pytest.mark.parametrize(
    ("steps", "window", "hits", "kept"),
    [([[A, B], [A], [B]], 3, 2, [0, 1, 1]), ([[A, B]] * 3, 3, 3, [0, 0, 2]), ([[A], [A], [B]], 2, 2, [0, 1, 0]), ([[A], [], [A]], 2, 2, [0, 0, 1]), ([[A], [B]], 1, 1, [1, 1])],
)
def test_persistence(spark, steps, window, hits, kept):
    rows = [(f, i, *p) for f, ps in enumerate(steps) for i, p in enumerate(ps)]
    out = keep_persistent(spark.createDataFrame(rows, POINTS), 1.0, window, hits).filter("keep").groupBy("frame_id").count().collect()
    found = {r.frame_id: r["count"] for r in out}
    assert [found.get(f, 0) for f in range(len(steps))] == kept


@pytest.mark.parametrize("bad", [{"voxel_size": 0}, {"window_size": 0}, {"min_hits": -1}])
def test_persistence_settings(spark, bad):
    with pytest.raises(ValueError, match="must be positive"):
        keep_persistent(spark.createDataFrame([], POINTS), **bad)


def test_voxels_of_odd_numbers(spark):
    rows = spark.createDataFrame([(-0.05,), (0.3,), (float("nan"),), (float("inf"),)], "x double").select(voxel("x", 0.1).alias("v")).collect()
    assert [r.v for r in rows] == [-1, 2, -(1 << 63), -(1 << 63)]


def test_ghosts(spark):
    rng = np.random.default_rng(3)
    rows = [(f, i, *map(float, rng.uniform(0, 4, 3))) for f in range(6) for i in range(60)]
    marked = keep_persistent(spark.createDataFrame(rows, POINTS), 0.8, 3, 2)
    raw, clean = set(), set()
    got = {r.frame_id: r for r in acc.cumulative_voxels(marked).collect()}
    kept = {(r.frame_id, r.point_id) for r in marked.filter("keep").collect()}
    for f in range(6):
        for _, i, x, y, z in rows[f * 60 : f * 60 + 60]:
            cell = tuple(math.floor(a / 0.8) for a in (x, y, z))
            raw.add(cell)
            if (f, i) in kept:
                clean.add(cell)
        assert (got[f].raw, got[f].clean, got[f].ghost) == (len(raw), len(clean), len(raw - clean))
    assert {(r.vx, r.vy, r.vz) for r in acc.ghost_voxels(marked).collect()} == raw - clean
    top = acc.peak(acc.cumulative_voxels(marked)).first()
    assert top.window_start == max(0, top.peak_index - 2) and top.window_end == min(5, top.peak_index + 2)


def test_views_of_points(spark):
    rng = np.random.default_rng(8)
    rows = [(f, i, *map(float, rng.uniform(0, 4, 3))) for f in range(6) for i in range(60)]
    marked = keep_persistent(spark.createDataFrame(rows, POINTS), 0.8, 3, 2)
    views = acc.both_views(marked)
    cells = lambda df: sorted(map(tuple, df.collect()))
    assert cells(acc.clean_view(views)) == cells(acc.birds_eye(marked.filter("keep"))) and cells(acc.ghost_view(views)) == cells(acc.birds_eye(acc.ghost_voxels(marked)))


def test_giant_boxes_and_odd_centres(spark):
    rng = np.random.default_rng(2)
    rows, points = cloud(spark, rng, n=50)
    given = [(0, 1, 0.0, 0.0, 0.0, 1e9, 1e9, 1.0, 0.3, None), (1, 2, 1e6, 0.0, 0.0, 2e6 + 2, 3e4, 5.0, 0.0, None), (2, 3, float("nan"), 0.0, 0.0, 9.0, 9.0, 9.0, 0.0, None)]
    boxes = spark.createDataFrame(given, BOXES)
    want = brute_crop(rows, given[:2], crop.MARGIN)
    key = lambda df: sorted((r.frame_id, r.point_id) for r in df.collect())
    assert key(crop.remove_points(points, boxes)) == key(crop.mark_points(points, boxes).filter("keep")) == want and len(want) < 150


def test_views_and_spots(spark):
    views = spark.createDataFrame([(0, 0, 5, 2), (5, 5, 5, 0), (9, 9, 1, 0), (1, 1, 0, 4), (20, 20, 0, 4)], "vx long, vy long, clean_cells long, ghost_cells long")
    clean = acc.clean_view(views)
    assert {(r.vx, r.vy): r.total_cells for r in acc.merged_view(views).collect()} == {(0, 0): 7, (5, 5): 5, (9, 9): 1, (1, 1): 4, (20, 20): 4}
    assert {(r.vx, r.vy, r.cells): r.near for r in acc.near_ghosts(views).collect()} == {(0, 0, 5): 6, (5, 5, 5): 0, (9, 9, 1): 0}
    assert tuple(acc.hotspot(views).first())[:2] == (1, 1)
    assert tuple(acc.preserved_spot(views).first())[:2] == (5, 5)
    assert tuple(acc.preserved_spot(views.filter("ghost_cells > 0")).first())[:2] == (0, 0)
    stats = acc.crop_stats(views, acc.hotspot(views), 0.5).first()
    assert (stats.raw_cells, stats.clean_cells, stats.ghost_cells, stats.overlap_pct) == (3, 2, 2, 67)
    empty = acc.view_bounds(clean.limit(0), 1.0).first()
    assert (empty.xmin, empty.xmax, empty.max_cells) == (-1, 1, 0)


def test_limits_and_centroid(spark):
    points = spark.createDataFrame([(0, 0, 1.0, float("nan"), 2.0), (0, 1, -1.0, float("inf"), 4.0)], POINTS)
    r = acc.limits(points).first()
    assert (r.xmin, r.xmax, r.ymin, r.ymax, r.zmax) == (-1, 1, -1, 1, 4)
    assert tuple(acc.centroid(points.limit(0), (1, 2, 3)).first()) == (1, 2, 3)


def test_poses(spark):
    half = math.sqrt(0.5)
    poses = poses_from_quaternions(spark.createDataFrame([(200, half, 0.0, 0.0, half, 10.0, 20.0, 30.0)], "timestamp_ns long, qw double, qx double, qy double, qz double, tx_m double, ty_m double, tz_m double"))
    points = spark.createDataFrame([(200, 0, 1.0, 0.0, 0.0), (200, 1, 0.0, 1.0, 0.0)], "timestamp_ns long, point_id long, x double, y double, z double")
    moved = align.move_points(align.join_poses(points, poses)).orderBy("point_id").collect()
    assert [(round(r.x, 9), round(r.y, 9), r.z) for r in moved] == [(10, 21, 30), (9, 20, 30)]
    boxes = spark.createDataFrame([(200, 1.0, 0.0, 0.0, 4.0, 2.0, 1.0, 0.0, "car")], "timestamp_ns long, cx double, cy double, cz double, l double, w double, h double, yaw double, label string")
    b = align.move_boxes(align.join_poses(boxes, poses)).first()
    assert (round(b.cx, 9), round(b.cy, 9), b.cz, b.label) == (10, 21, 30, "car") and b.yaw == pytest.approx(math.pi / 2)
    with pytest.raises(Exception, match="no pose for timestamp 7"):
        align.join_poses(points.withColumn("timestamp_ns", F.lit(7)), poses).collect()
    with pytest.raises(Exception, match="norm must be non-zero"):
        quaternion_matrix(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "qw double, qx double, qy double, qz double")).collect()


def test_frame_names(spark):
    rows = spark.createDataFrame([("d/315969904359876000.feather",), ("cloud.pcd",), ("d/a12.pcd",), ("7",)], "path string").select(align.frame_timestamp(F.col("path")).alias("t")).collect()
    assert [r.t for r in rows] == [315969904359876000, None, None, 7]


@pytest.mark.parametrize(("text", "want"), [("[]", True), ('{"objects": []}', True), ('{"yaw": 1}', False), ('{"x": 1, "shape": []}', True), ('{"targets": []}', False), ('{"a.pcd": []}', False), ("oops", False)])
def test_global_payload(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(align.is_global_payload(F.col("t"))).first()[0] is want


def test_box_maps(spark):
    frames_ = spark.createDataFrame([("r/s/a.pcd",), ("r/s/b.pcd",), ("r/t/c.pcd",), ("r/u/d.pcd",)], "path string")
    known = spark.createDataFrame([("s", "folder"), ("b.pcd", "name"), ("t/c.pcd", "pair"), ("r/t/c.pcd", "path")], "key string, payload string")
    assert {r.path[-5]: r.payload for r in align.resolve_payloads(frames_, known).collect()} == {"a": "folder", "b": "folder", "c": "pair", "d": None}


def test_nearest_in_time(spark):
    rng = np.random.default_rng(4)
    left = [(i, float(t)) for i, t in enumerate(rng.integers(0, 60, 40))]
    right = [(i, float(t)) for i, t in enumerate(rng.integers(0, 60, 15))]
    want = {}
    for i, t in left:
        best = min(((abs(t - s), k) for k, s in right if abs(t - s) < 3), default=None)
        if best:
            want[i] = best[1]
    a, b = spark.createDataFrame(left, "left_id long, stamp double"), spark.createDataFrame(right, "arrival long, stamp double")
    assert {r.left_id: r.arrival for r in align.nearest_in_time(a, b, 3.0).collect()} == want


@pytest.mark.parametrize(("start", "count", "stride"), [(0, None, 1), (2, 3, 2), (-4, 2, 2), (8, 5, 1), (-3, None, 2), (-9, 4, 1)])
def test_slices(spark, start, count, stride):
    names = [f"f{i:02d}" for i in range(10)]
    end = None if count is None else start + count * stride
    out = frames.slice_frames(spark.createDataFrame([(n,) for n in names], "path string"), start, count, stride).orderBy("index").collect()
    want = names[start:end:stride]
    assert [r.path for r in out] == want


def test_sampling(spark):
    points = spark.range(1000).withColumnRenamed("id", "point_id")
    a = {r.point_id for r in frames.sample_points(points, 50, 7).collect()}
    assert len(a) == 50 and a == {r.point_id for r in frames.sample_points(points.repartition(5), 50, 7).collect()} != {r.point_id for r in frames.sample_points(points, 50, 8).collect()}
    assert frames.sample_points(points, 0, 1).count() == 1000 and frames.sample_points(points, 5000, 1).count() == 1000


def test_latency(spark):
    r = frames.latency(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "ms double")).first()
    assert (r.p50_ms, r.max_ms, r.min_ms) == (2, 4, 1) and r.p95_ms == pytest.approx(np.percentile([1, 2, 4], 95))
    assert tuple(frames.latency(spark.createDataFrame([], "ms double")).first()) == (0, 0, 0, 0, 0)


def test_clusters(spark):
    rows = []
    for k, (x, y, n) in enumerate([(0, 0, 30), (20, 0, 18), (40, 0, 17), (60, 0, 50), (80, 0, 25)]):
        rows += [(0, 1000 * k + i, x + 0.02 * i, y + 0.01 * i, 0.1 * (i % 3)) for i in range(n)]
    rows += [(0, 9000 + i, 100 + 0.5 * i, 0.0, 0.0) for i in range(300)]
    out = clusters.derive_boxes(spark.createDataFrame([(f, i, float(x), float(y), float(z)) for f, i, x, y, z in rows], POINTS)).orderBy("rank").collect()
    assert [(r.label[-1], r.points) for r in out] == [("3", 50), ("1", 30), ("4", 25)]
    assert out[1].l == pytest.approx(1.38) and out[1].w == 1.275 and out[1].h == 1.2 and out[1].cx == pytest.approx(0.29)


def test_scene_document(spark):
    import json

    from voxelgate.plans.scene import accumulate, document

    rng = np.random.default_rng(6)
    rows, points = cloud(spark, rng, n=50)
    boxes = spark.createDataFrame([(f, f, 0.0, 0.0, 0.0, 4.0, 4.0, 4.0, 0.3, "car") for f in range(3)], BOXES)
    doc = json.loads(document(accumulate(points, boxes, voxel_size=0.5), sample=10).first()["document"])
    assert doc["meta"]["input_points"] == 150 and doc["meta"]["frame_count"] == 3 and len(doc["path"]) == 3
    assert doc["meta"]["kept_points"] + doc["meta"]["removed_points"] == 150 and len(doc["frames"][0]["input"]) == 30
    assert doc["frames"][0]["objects"][0]["label"] == "car" and len(doc["bev"]["clean"]) % 3 == 0
    doc = json.loads(document(accumulate(points, voxel_size=2.0)).first()["document"])
    assert doc["meta"]["input_points"] == 150 and "objects" not in doc["frames"][0]


def test_crowded_boxes(spark, monkeypatch):
    """Of boxes over each other a cell lists few, however many there are, and the result is that of brute force."""
    rng = np.random.default_rng(11)
    given = [(0, k, *map(float, rng.uniform(-4, 4, 2)), float(rng.uniform(-0.5, 0.5)), 4.0, 3.0, float(rng.uniform(0.5, 3)), float(rng.uniform(-4, 4)), "b") for k in range(400)]
    given += [(0, 1000 + k, *r[2:]) for k, r in enumerate(given[:200])] + [(1, 9, 0.0, 0.0, 0.0, 300.0, 2.0, 2.0, 0.7, None)]
    rows = [(f, i, *map(float, rng.uniform(-8, 8, 2)), float(rng.uniform(-2.5, 2.5))) for i, f in enumerate(rng.integers(0, 2, 500).tolist())]
    points, boxes = spark.createDataFrame(rows, POINTS).checkpoint(), spark.createDataFrame(given, BOXES).checkpoint()
    monkeypatch.setattr(crop, "CROWDED", 16)
    listed, cell = crop.prepare(points, boxes, crop.MARGIN, "frame_id", crop.CELL)
    assert cell < crop.CELL
    at = points.selectExpr("frame_id", f"floor(x / {cell}) AS _gx", f"floor(y / {cell}) AS _gy")
    pairs = at.join(listed, ["frame_id", "_gx", "_gy"]).count()
    monkeypatch.setattr(crop, "CROWDED", 1 << 30)
    coarse, side = crop.prepare(points, boxes, crop.MARGIN, "frame_id", crop.CELL)
    plain = points.selectExpr("frame_id", f"floor(x / {side}) AS _gx", f"floor(y / {side}) AS _gy").join(coarse, ["frame_id", "_gx", "_gy"]).count()
    assert pairs * 10 < plain
    monkeypatch.setattr(crop, "CROWDED", 16)
    key = lambda df: sorted((r.frame_id, r.point_id) for r in df.collect())
    want = sorted(brute_crop(rows, given, crop.MARGIN))
    assert key(crop.remove_points(points, boxes)) == want and 0 < len(want) < len(rows)
    assert key(crop.mark_points(points, boxes).filter("keep")) == want


def scene_points(spark, n=4000):
    """Four frames, in which some coordinates are NaN or null."""
    rows = "CAST(id % 4 AS INT) AS frame_id; id AS point_id; (id * 7 % 13) * 0.5D AS x; CASE WHEN id % 50 = 3 THEN double('NaN') ELSE (id * 3 % 11) * 0.5D END AS y; CASE WHEN id % 70 <> 5 THEN (id % 5) * 0.25D END AS z"
    return spark.range(n).selectExpr(*rows.split("; "))


def test_scene_figures_by_voxel_are_those_of_the_points(spark):
    marked = temporal.keep_persistent(scene_points(spark), 1.0, 2, 2)
    voxels = acc.by_voxel(marked)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(acc.frame_totals(voxels).select("frame_id", "input_points", "kept_points", "removed_points")) == rows(acc.per_frame(marked))
    assert rows(acc.limits(voxels)) == rows(acc.limits(marked))
    assert rows(acc.both_views(voxels)) == rows(acc.both_views(marked))
    assert rows(acc.cumulative_voxels(voxels)) == rows(acc.cumulative_voxels(marked))
    rounded = lambda df: rows(df.selectExpr("frame_id", *[f"round(c{a}, 9) AS c{a}" for a in "xyz"]))
    assert rounded(acc.frame_totals(voxels)) == rounded(acc.centres(marked))


def test_samples_of_parts_are_those_of_each_part(spark):
    marked = temporal.keep_persistent(scene_points(spark), 1.0, 2, 2)
    counts = acc.per_frame(marked)
    for size in (5, 900, 0):
        got = frames.sample_parts(marked, counts, size, 7)
        for name, part in (("input", marked), ("kept", marked.filter("keep")), ("removed", marked.filter("NOT keep"))):
            ids = lambda df: sorted(r.point_id for r in df.select("point_id").collect())
            assert ids(got[name]) == ids(frames.sample_each_frame(part, size, 7))


def test_few_voxels_leave_the_points_where_they_are(spark, monkeypatch):
    points = scene_points(spark)
    name = "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        near = temporal.keep_persistent(points, 1.0, 2, 2)
        assert "BroadcastHashJoin" in plan(near) and "SortMergeJoin" not in plan(near)
        monkeypatch.setattr(temporal, "_BROADCAST_VOXELS", 0)
        far = temporal.keep_persistent(points, 1.0, 2, 2)
        assert "BroadcastHashJoin" not in plan(far)
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    finally:
        spark.conf.set(name, before)
