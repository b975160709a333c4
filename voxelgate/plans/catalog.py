"""Named queries of the point-cloud engine over derived views, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.payload import document, message_stamp, parse_boxes
from ..operators import accumulate as acc
from ..operators import align, crop, frames
from ..operators.clusters import split_by_boxes
from ..operators.temporal import CELL, number_frames, voxel_hits
from ..sources.boxes import camera_to_lidar, poses_from_quaternions
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_PER_FRAME = "SELECT frame_id, count(*) AS points, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM {} GROUP BY frame_id"
_KEPT = f"WITH {v.POINTS_SQL}, {v.BOXES_SQL}, k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE {v.INSIDE_SQL})) {_PER_FRAME.format('k')}"


def _per_frame(df: DataFrame) -> DataFrame:
    return df.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.sum("l_orderkey").alias("key_sum"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return acc.both_views(v.persistent(spark, sf))


@query(_KEPT)
def jon_01_box_crop(spark, sf):
    return _per_frame(crop.remove_points(v.points(spark, sf), v.boxes(spark, sf)))


@query(_KEPT)
def jon_01_frame_crop(spark, sf):
    """On a grid so fine that most boxes go by its hierarchy."""
    return _per_frame(crop.remove_points(v.points(spark, sf), v.boxes(spark, sf), cell=0.5))


@query(f"WITH {v.POINTS_SQL}, {v.BOXES_SQL}, k AS (SELECT * FROM p WHERE EXISTS (SELECT 1 FROM b WHERE {v.INSIDE_SQL})) {_PER_FRAME.format('k')}")
def flt_07_removed_points(spark, sf):
    return _per_frame(crop.points_in_boxes(v.points(spark, sf), v.boxes(spark, sf)))


@query(f"WITH {v.CROPPED_SQL} SELECT frame_id, count(*) AS input_points, count(*) FILTER (keep) AS kept_points, count(*) FILTER (NOT keep) AS removed_points FROM m GROUP BY frame_id")
def jon_02_keep_mask(spark, sf):
    return acc.per_frame(v.cropped(spark, sf))


@query(f"WITH {v.POINTS_SQL}, {v.BOXES_SQL.replace(' + 0.05e0', '')}, m AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM b WHERE {v.INSIDE_SQL}) AS keep FROM p) SELECT frame_id, count(*) FILTER (keep) AS kept_points FROM m GROUP BY frame_id")
def flt_08_split_without_margin(spark, sf):
    return acc.per_frame(split_by_boxes(v.points(spark, sf), v.boxes(spark, sf))).select("frame_id", "kept_points")


@query("SELECT p_partkey AS box_id FROM part WHERE p_size >= 10 AND p_retailprice / 95.0e0 >= 10 AND 12.0e0 >= 10")
def flt_04_min_size(spark, sf):
    sides = v.table(spark, sf, "part").selectExpr("p_partkey AS box_id", "CAST(p_size AS DOUBLE) AS l", "p_retailprice / 95.0D AS w", "12.0D AS h")
    return crop.drop_small_boxes(sides, 10.0).select("box_id")


@query(f"WITH {v.CROPPED_SQL} SELECT count(*) AS total_points, count(*) FILTER (keep) AS kept_points, count(*) FILTER (NOT keep) AS removed_points, count(*) FILTER (NOT keep) / CAST(count(*) AS DOUBLE) AS removed_ratio FROM m")
def agg_01_summary(spark, sf):
    return crop.summarise(v.cropped(spark, sf))


@query(f"WITH {v.POINTS_SQL}, {v.VOXELS_SQL} SELECT frame_id, count(*) AS voxels FROM (SELECT DISTINCT frame_id, vx, vy, vz FROM v) GROUP BY frame_id")
def agg_02_voxels(spark, sf):
    cells = geo.with_voxels(v.points(spark, sf), v.VOXEL).select("frame_id", *CELL).distinct()
    return cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"WITH {v.PERSISTENT_SQL} SELECT frame_id, hits, count(*) AS voxels FROM h GROUP BY frame_id, hits")
def agg_03_voxel_hits(spark, sf):
    return voxel_hits(v.points(spark, sf), v.VOXEL, v.WINDOW).groupBy("frame_id", "hits").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"WITH {v.PERSISTENT_SQL} SELECT frame_id, count(*) AS input_points, count(*) FILTER (keep) AS kept_points, count(*) FILTER (NOT keep) AS removed_points FROM m GROUP BY frame_id")
def win_01_temporal(spark, sf):
    return acc.per_frame(v.persistent(spark, sf))


@query(f"WITH {v.CUMULATIVE_SQL} SELECT frame_id, frame_seq, raw, clean, ghost, round(ghost_pct, 6) AS ghost_pct FROM cv")
def win_02_ghost_cumulative(spark, sf):
    return _rounded(acc.cumulative_voxels(v.persistent(spark, sf)), "ghost_pct")


@query(f"WITH {v.CROPPED_SQL}, g AS (SELECT frame_id, count(*) AS n, count(*) FILTER (keep) AS k FROM m GROUP BY frame_id) SELECT frame_id, CAST(sum(n) OVER w AS BIGINT) AS points, CAST(sum(k) OVER w AS BIGINT) AS kept, count(*) OVER w AS path FROM g WINDOW w AS (ORDER BY frame_id)")
def win_03_prefix(spark, sf):
    return acc.prefix_counts(v.cropped(spark, sf))


@query(f"WITH {v.POINTS_SQL} SELECT frame_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM p GROUP BY frame_id")
def win_04_path(spark, sf):
    return _rounded(acc.centres(v.points(spark, sf)), "cx", "cy", "cz")


@query(f"""WITH {v.CUMULATIVE_SQL}, n AS (SELECT max(frame_seq) AS n FROM cv), top AS (SELECT * FROM cv ORDER BY ghost_pct DESC, frame_seq LIMIT 1)
SELECT frame_id, frame_seq - 1 AS peak_index, greatest(0, frame_seq - 3) AS window_start, least(n - 1, frame_seq + 1) AS window_end, round(ghost_pct, 6) AS ghost_pct FROM top, n""")
def win_05_peak(spark, sf):
    return _rounded(acc.peak(acc.cumulative_voxels(v.persistent(spark, sf))).drop("reduction_pct"), "ghost_pct")


@query(f"WITH {v.CROPPED_SQL} SELECT frame_id, count(*) FILTER (NOT keep) AS removed_points FROM m GROUP BY frame_id ORDER BY 2 DESC, 1 LIMIT 1")
def win_06_most_removed(spark, sf):
    return acc.most_removed(v.cropped(spark, sf)).select("frame_id", "removed_points")


@query(f"WITH {v.CUMULATIVE_SQL} SELECT CAST(round(1000 - 10 * ghost_pct) AS BIGINT) AS reduction_permille FROM cv ORDER BY frame_seq DESC LIMIT 1")
def win_07_reduction(spark, sf):
    return acc.peak(acc.cumulative_voxels(v.persistent(spark, sf))).select(F.round(F.col("reduction_pct") * 10).cast("long").alias("reduction_permille"))


@query(f"WITH {v.CUMULATIVE_SQL} SELECT frame_id, frame_seq, round(ghost_pct, 6) AS ghost_pct, round(greatest(1.0e0, max(ghost_pct) OVER ()), 6) AS scale FROM cv")
def win_08_timeline(spark, sf):
    return _rounded(acc.timeline(acc.cumulative_voxels(v.persistent(spark, sf))), "ghost_pct", "scale")


@query(f"WITH {v.BEV_SQL} SELECT vx, vy, cells FROM clean")
def agg_04_bev(spark, sf):
    return acc.clean_view(_views(spark, sf))


_BOUNDS = f"min(round((vx + 0.5e0) * {v.VOXEL}e0, 3)) AS xmin, max(round((vx + 0.5e0) * {v.VOXEL}e0, 3)) AS xmax, min(round((vy + 0.5e0) * {v.VOXEL}e0, 3)) AS ymin, max(round((vy + 0.5e0) * {v.VOXEL}e0, 3)) AS ymax"


@query(f"WITH {v.BEV_SQL}, e AS (SELECT {_BOUNDS} FROM clean UNION ALL SELECT {_BOUNDS} FROM ghost) SELECT CAST(round(min(xmin), 1) AS DOUBLE) AS xmin, CAST(round(max(xmax), 1) AS DOUBLE) AS xmax, CAST(round(min(ymin), 1) AS DOUBLE) AS ymin, CAST(round(max(ymax), 1) AS DOUBLE) AS ymax FROM e")
def agg_05_merged_bounds(spark, sf):
    views = _views(spark, sf)
    both = acc.merge_bounds(acc.view_bounds(acc.clean_view(views), v.VOXEL), acc.view_bounds(acc.ghost_view(views), v.VOXEL))
    return both.withColumns({c: F.round(c, 1) for c in both.columns})


_ENDS = ", ".join(f"{f}({a}) AS {a}{f}" for a in "xyz" for f in ("min", "max"))


@query(f"WITH {v.POINTS_SQL} SELECT " + ", ".join(f"round({f}({a}), 3) AS {a}{f}" for a in "xyz" for f in ("min", "max")) + " FROM p")
def agg_06_limits(spark, sf):
    return acc.limits(v.points(spark, sf))


@query(f"WITH {v.POINTS_SQL} SELECT {_ENDS} FROM p")
def agg_07_exact_bounds(spark, sf):
    return acc.exact_bounds(v.points(spark, sf))


@query(f"WITH {v.POINTS_SQL} SELECT round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM p")
def agg_08_centroid(spark, sf):
    return _rounded(acc.centroid(v.points(spark, sf)), "cx", "cy", "cz")


@query("SELECT round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(max(value), 6) AS max_ms, round(min(value), 6) AS min_ms FROM events")
def agg_10_latency(spark, sf):
    figures = frames.latency(v.table(spark, sf, "events"), "value")
    return _rounded(figures, *figures.columns)


@query("SELECT round(count(*) / (avg(value) / 1000.0e0) / 1000.0e0, 6) AS kpts_per_s FROM events")
def agg_12_throughput(spark, sf):
    rows = v.table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("ms"))
    return rows.select(F.round(frames.throughput(F.col("n"), F.col("ms")), 6).alias("kpts_per_s"))


@query("SELECT count(DISTINCT ts) AS timestamps FROM events")
def agg_14_timestamps(spark, sf):
    return v.table(spark, sf, "events").agg(F.count_distinct("ts").alias("timestamps"))


@query(f"WITH {v.BOXES_SQL} SELECT frame_id, count(*) AS objects, string_agg(label, '|' ORDER BY box_id) AS labels FROM raw_b GROUP BY frame_id")
def agg_15_objects(spark, sf):
    listed = frames.object_list(v.boxes(spark, sf), frame="frame_id")
    return listed.select("frame_id", F.size("objects").cast("long").alias("objects"), F.concat_ws("|", F.transform("objects", lambda o: o["label"])).alias("labels"))


@query(f"WITH {v.BEV_SQL}, raw AS (SELECT vx, vy, vz FROM v GROUP BY ALL), k AS (SELECT vx, vy, vz FROM m WHERE keep GROUP BY ALL) SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM k) AS clean, (SELECT count(*) FROM (SELECT * FROM raw EXCEPT SELECT * FROM k)) AS ghost")
def set_02_voxel_diff(spark, sf):
    marked = v.persistent(spark, sf)
    cells = marked.groupBy(*CELL).agg(F.max("keep").alias("k"))
    ghost = acc.ghost_voxels(marked).agg(F.count(F.lit(1)).alias("ghost"))
    return cells.agg(F.count(F.lit(1)).alias("raw"), F.count_if("k").alias("clean")).crossJoin(ghost)


_POSE_SQL = """q AS (SELECT DISTINCT frame_id, frame_id * 0.3e0 AS a, frame_id * 1.5e0 AS tx, frame_id * 0.5e0 AS ty FROM p)"""


@query(f"WITH {v.POINTS_SQL}, {_POSE_SQL} SELECT frame_id, round(avg(cos(a) * x - sin(a) * y + tx), 6) AS cx, round(avg(sin(a) * x + cos(a) * y + ty), 6) AS cy, round(avg(z + 2.0e0), 6) AS cz FROM p JOIN q USING (frame_id) GROUP BY frame_id")
def prj_04_pose_points(spark, sf):
    rows = v.points(spark, sf).withColumn("timestamp_ns", F.col("frame_id").cast("long"))
    moved = align.move_points(align.join_poses(rows, poses_from_quaternions(v.quaternions(spark, sf))))
    return _rounded(acc.centres(moved), "cx", "cy", "cz")


@query(f"WITH {v.POINTS_SQL}, {v.BOXES_SQL}, {_POSE_SQL} SELECT box_id, round(cos(a) * cx - sin(a) * cy + tx, 6) AS cx, round(sin(a) * cx + cos(a) * cy + ty, 6) AS cy, round(cz + 2.0e0, 6) AS cz, round(cos(a + yaw), 6) AS cos_yaw, round(sin(a + yaw), 6) AS sin_yaw FROM raw_b JOIN q USING (frame_id)")
def prj_05_pose_boxes(spark, sf):
    rows = v.boxes(spark, sf).withColumn("timestamp_ns", F.col("frame_id").cast("long"))
    moved = align.move_boxes(align.join_poses(rows, poses_from_quaternions(v.quaternions(spark, sf))))
    return _rounded(moved.select("box_id", "cx", "cy", "cz", F.cos("yaw").alias("cos_yaw"), F.sin("yaw").alias("sin_yaw")), "cx", "cy", "cz", "cos_yaw", "sin_yaw")


@query(f"WITH {v.POINTS_SQL}, {_POSE_SQL} SELECT CAST(frame_id AS BIGINT) AS timestamp_ns, round(cos(a), 6) AS r00, round(-sin(a), 6) AS r01, round(sin(a), 6) AS r10, round(cos(a), 6) AS r11, 1.0e0 AS r22 FROM q")
def prj_06_quaternion_matrix(spark, sf):
    poses = poses_from_quaternions(v.quaternions(spark, sf))
    return _rounded(poses.select("timestamp_ns", "r00", "r01", "r10", "r11", "r22"), "r00", "r01", "r10", "r11", "r22")


@query(f"WITH {v.POINTS_SQL}, {_POSE_SQL} SELECT CAST(frame_id AS BIGINT) AS timestamp_ns, round(atan2(sin(a), cos(a)), 6) AS yaw FROM q")
def prj_07_quaternion_yaw(spark, sf):
    q = v.quaternions(spark, sf)
    return q.select("timestamp_ns", F.round(geo.quaternion_yaw(*[F.col(f"q{a}") for a in "wxyz"]), 6).alias("yaw"))


@query(f"WITH {v.BOXES_SQL} SELECT box_id, round(cz, 6) + 0.0e0 AS x, round(-cx, 6) + 0.0e0 AS y, round(-cy, 6) + 0.0e0 AS z, round(-(yaw + pi() / 2), 6) AS yaw FROM raw_b")
def prj_08_camera_axes(spark, sf):
    x, y, z, yaw = camera_to_lidar(*[F.col(c) for c in ("cx", "cy", "cz", "yaw")], None)
    plain = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zero
    return v.boxes(spark, sf).select("box_id", plain(x).alias("x"), plain(y).alias("y"), plain(z).alias("z"), F.round(yaw, 6).alias("yaw"))


@query(f"WITH {v.POINTS_SQL}, o AS (SELECT avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM p WHERE frame_id = (SELECT min(frame_id) FROM p)) SELECT frame_id, round(avg(x) - any_value(ox), 6) AS cx, round(avg(y) - any_value(oy), 6) AS cy, round(avg(z) - any_value(oz), 6) AS cz FROM p, o GROUP BY frame_id")
def prj_09_reorigin(spark, sf):
    p = v.points(spark, sf)
    return _rounded(acc.centres(align.shift_origin(p, align.origin(p))), "cx", "cy", "cz")


@query(f"WITH {v.POINTS_SQL}, q AS (SELECT DISTINCT frame_id FROM p WHERE frame_id <= 6) SELECT frame_id, count(*) AS points FROM p JOIN q USING (frame_id) GROUP BY frame_id")
def jon_03_known_poses(spark, sf):
    rows = v.points(spark, sf).withColumn("timestamp_ns", F.col("frame_id").cast("long"))
    poses = poses_from_quaternions(v.quaternions(spark, sf).filter("timestamp_ns <= 6"))
    return align.join_poses(rows, poses, strict=False).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"))


@query("""SELECT 'scene' || event_id % 7 || '/' || event_id || '.pcd' AS path,
CASE WHEN event_id % 7 = 3 THEN 'folder' WHEN event_id % 4 = 0 THEN 'name' || event_id WHEN event_id % 4 = 1 THEN 'stem' || event_id WHEN event_id % 4 = 2 THEN 'path' || event_id END AS payload FROM events""")
def jon_04_box_map(spark, sf):
    """Payloads named by folder, file name, stem or path; where two names are known the first kind counts."""
    events = v.table(spark, sf, "events").withColumn("path", F.expr("concat('scene', event_id % 7, '/', event_id, '.pcd')"))
    key = "CASE event_id % 4 WHEN 0 THEN concat(event_id, '.pcd') WHEN 1 THEN CAST(event_id AS STRING) ELSE path END AS key"
    payload = "concat(CASE event_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'stem' ELSE 'path' END, event_id) AS payload"
    known = events.filter("event_id % 4 < 3").selectExpr(key, payload)
    known = known.unionByName(events.filter("event_id % 7 = 3").selectExpr("'scene3' AS key", "'folder' AS payload").distinct())
    return align.resolve_payloads(events.select("path"), known).select("path", "payload")


_NEAREST = f"""WITH c AS (SELECT event_id AS cloud_id, epoch_us(ts) / 1000000.0e0 AS stamp FROM events WHERE event_type = 'view'),
m AS (SELECT event_id AS arrival, epoch_us(ts) / 1000000.0e0 AS box_stamp FROM events WHERE event_type = 'error'),
j AS (SELECT cloud_id, arrival, row_number() OVER (PARTITION BY cloud_id ORDER BY abs(stamp - box_stamp), arrival) AS n FROM c JOIN m ON abs(stamp - box_stamp) < {v.TOLERANCE})
SELECT cloud_id, arrival FROM j WHERE n = 1"""


@query(_NEAREST)
def jon_07_asof_nearest(spark, sf):
    clouds, messages = v.messages(spark, sf, "view", "cloud_id"), v.messages(spark, sf, "error", "arrival")
    return align.nearest_in_time(clouds, messages, v.TOLERANCE, key="cloud_id").select("cloud_id", "arrival")


@query(f"WITH {v.BEV_SQL} SELECT vx, vy, coalesce(clean.cells, 0) AS clean_cells, coalesce(ghost.cells, 0) AS ghost_cells, coalesce(clean.cells, 0) + coalesce(ghost.cells, 0) AS total_cells FROM clean FULL OUTER JOIN ghost USING (vx, vy)")
def jon_09_bev_outer(spark, sf):
    return acc.merged_view(_views(spark, sf))


_NEAR = "n AS (SELECT c.vx, c.vy, c.cells, CAST(coalesce(sum(g.cells), 0) AS BIGINT) AS near FROM clean c LEFT JOIN ghost g ON abs(g.vx - c.vx) <= 1 AND abs(g.vy - c.vy) <= 1 GROUP BY c.vx, c.vy, c.cells)"


@query(f"WITH {v.BEV_SQL}, {_NEAR} SELECT * FROM n")
def jon_10_neighbour_ghost(spark, sf):
    return acc.near_ghosts(_views(spark, sf))


@query(f"WITH {v.BEV_SQL}, {_NEAR} SELECT count(*) AS cells FROM n WHERE near = 0")
def jon_11_zero_ghost(spark, sf):
    return acc.near_ghosts(_views(spark, sf)).filter("near = 0").agg(F.count(F.lit(1)).alias("cells"))


@query(f"WITH {v.BEV_SQL} SELECT vx, vy, cells FROM ghost ORDER BY cells DESC, vx, vy LIMIT 1")
def srt_04_hotspot(spark, sf):
    return acc.hotspot(_views(spark, sf))


@query(f"WITH {v.BEV_SQL}, {_NEAR} SELECT vx, vy, cells, cells * 1000 - near AS score FROM n ORDER BY near > 0, score DESC, vx, vy LIMIT 1")
def srt_05_preserved(spark, sf):
    return acc.preserved_spot(_views(spark, sf)).select("vx", "vy", "cells", "score")


@query(f"""WITH {v.BEV_SQL}, spot AS (SELECT vx AS hx, vy AS hy FROM ghost ORDER BY cells DESC, vx, vy LIMIT 1),
r AS (SELECT vx, vy, coalesce(clean.cells, 0) AS c, coalesce(ghost.cells, 0) AS g FROM clean FULL OUTER JOIN ghost USING (vx, vy)),
i AS (SELECT * FROM r, spot WHERE abs(vx - hx) <= 5 AND abs(vy - hy) <= 5)
SELECT count(*) AS raw_cells, count(*) FILTER (c > 0) AS clean_cells, count(*) FILTER (g > 0) AS ghost_cells, CAST(floor(100.0e0 * count(*) FILTER (c > 0) / greatest(1, count(*)) + 0.5) AS BIGINT) AS overlap_pct FROM i""")
def agg_18_crop_stats(spark, sf):
    views = _views(spark, sf)
    return acc.crop_stats(views, acc.hotspot(views), v.VOXEL)


@query("SELECT path, i - 2 AS place FROM (SELECT concat('run/', CAST(1000000 + c_custkey AS VARCHAR), '.pcd') AS path, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i >= 2 AND (i - 2) % 3 = 0 AND i < 2 + 3 * 400")
def srt_01_frame_slice(spark, sf):
    """A file for each customer; 400 of them from the third on, three apart."""
    names = v.table(spark, sf, "customer").select(F.concat(F.lit("run/"), (F.col("c_custkey") + 1_000_000).cast("string"), F.lit(".pcd")).alias("path"))
    return frames.slice_frames(names, 2, 400, 3).select("path", (F.col("index") - 2).alias("place"))


@query(f"""WITH {v.POINTS_SQL}, s AS (SELECT frame_id, l_orderkey * 10 + l_linenumber AS point_id, x FROM p)
SELECT frame_id, point_id, x FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5(concat(point_id, ':7')), point_id) AS place FROM s) WHERE place <= 100""")
def srt_06_sample(spark, sf):
    """The sampled points themselves."""
    rows = v.points(spark, sf).withColumn("point_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return frames.sample_each_frame(rows, 100, 7).select("frame_id", "point_id", "x")


@query("SELECT user_id AS timestamp_ns, arg_max(value, event_id) AS tx_m, max(event_id) % 10 AS ty_m FROM events GROUP BY user_id")
def srt_07_latest(spark, sf):
    """Of poses with equal timestamps the last row counts."""
    rows = v.table(spark, sf, "events").selectExpr("user_id AS timestamp_ns", "event_id AS row_no", "value AS tx_m", "event_id % 10 AS ty_m")
    return align.latest_poses(rows, "row_no")


@query("""SELECT event_id, 0 AS box_id, CAST(event_id % 50 AS DOUBLE) AS cx, value AS cy, 1.0e0 AS cz, 4.0e0 AS l, 2.0e0 AS w, 1.5e0 AS h,
round(radians(CAST(event_id % 360 AS DOUBLE)), 6) AS yaw, event_type AS label FROM events WHERE event_id % 5 <> 0 UNION ALL
SELECT event_id, i, CAST(event_id % 50 AS DOUBLE), value, 1.0e0, 4.0e0, 2.0e0, 1.5e0, 0.0e0, NULL FROM events, (VALUES (0), (1)) t(i) WHERE event_id % 5 = 0""")
def sca_json_payload(spark, sf):
    one = "concat('{\"center\":[', event_id % 50, ',', value, ',1],\"size\":{\"x\":4,\"y\":2,\"z\":1.5}')"
    rows = v.table(spark, sf, "events").selectExpr("event_id", f"CASE WHEN event_id % 5 = 0 THEN concat('{{\"objects\":[', {one}, '}},', {one}, '}},{{\"center\":[1,2]}}]}}') ELSE concat({one}, ',\"yaw_deg\":', event_id % 360, ',\"label\":\"', event_type, '\"}}') END AS payload")
    return _rounded(parse_boxes(rows, "payload"), "yaw").withColumn("box_id", F.col("box_id").cast("int"))


@query("SELECT event_id, round(1000.0e0 + event_id % 10 + (event_id % 7) * 0.1e0, 6) AS stamp FROM events")
def sca_message_stamp(spark, sf):
    rows = v.table(spark, sf, "events").selectExpr("event_id", "concat('{\"header\":{\"stamp\":{\"sec\":', 1000 + event_id % 10, ',\"nanosec\":', (event_id % 7) * 100000000, '}}}') AS payload")
    return rows.select("event_id", F.round(message_stamp(document(F.col("payload"))), 6).alias("stamp"))


@query(f"WITH {v.POINTS_SQL} SELECT frame_id, dense_rank() OVER (ORDER BY frame_id) AS frame_seq FROM (SELECT DISTINCT frame_id FROM p)")
def flt_10_frame_numbers(spark, sf):
    return number_frames(v.points(spark, sf))


@query("SELECT 'run/' || event_id || CASE WHEN event_id % 3 = 0 THEN 'a' ELSE '' END || '.feather' AS path, CASE WHEN event_id % 3 <> 0 THEN event_id END AS timestamp_ns FROM events")
def sca_frame_timestamp(spark, sf):
    rows = v.table(spark, sf, "events").selectExpr("concat('run/', event_id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE '' END, '.feather') AS path")
    return rows.withColumn("timestamp_ns", align.frame_timestamp(F.col("path")))
