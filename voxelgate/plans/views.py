"""Points, boxes and streams of messages, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crop import mark_points
from ..operators.temporal import keep_persistent

#: Settings of the derived queries: fine enough that ghosts remain at every scale.
VOXEL, WINDOW, HITS = 0.35, 5, 2
TOLERANCE = 250.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve frames, one for each month."""
    return table(spark, sf_dir, "lineitem").selectExpr("month(l_shipdate) AS frame_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity - 25.0D AS x", "l_extendedprice / 2000.0D - 26.0D AS y", "l_tax * 50.0D AS z")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey % 12 + 1 AS INT) AS frame_id", "p_partkey AS box_id", "p_size - 25.0D AS cx", "(p_retailprice - 900.0D) * 4.0D - 20.0D AS cy", "2.0D AS cz", "6.0D AS l", "3.0D AS w", "2.0D + (p_partkey % 3) AS h", "(p_partkey % 13) * 0.5D AS yaw", "p_type AS label"
    )


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose for each frame; the timestamp is the frame's number."""
    return points(spark, sf_dir).select("frame_id").distinct().selectExpr("CAST(frame_id AS BIGINT) AS timestamp_ns", "cos(frame_id * 0.15D) AS qw", "0.0D AS qx", "0.0D AS qy", "sin(frame_id * 0.15D) AS qz", "frame_id * 1.5D AS tx_m", "frame_id * 0.5D AS ty_m", "2.0D AS tz_m")


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_points(points(spark, sf_dir), boxes(spark, sf_dir))


def persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_persistent(points(spark, sf_dir), VOXEL, WINDOW, HITS)


def messages(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).selectExpr(f"event_id AS {name}", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0D AS stamp")


#: The same views in DuckDB's SQL.
POINTS_SQL = """p AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS frame_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity - 25.0e0 AS x, l_extendedprice / 2000.0e0 - 26.0e0 AS y, l_tax * 50.0e0 AS z FROM lineitem)"""
BOXES_SQL = """raw_b AS (SELECT CAST(p_partkey % 12 + 1 AS INTEGER) AS frame_id, p_partkey AS box_id, p_size - 25.0e0 AS cx,
    (p_retailprice - 900.0e0) * 4.0e0 - 20.0e0 AS cy, 2.0e0 AS cz, 6.0e0 AS l, 3.0e0 AS w, 2.0e0 + (p_partkey % 3) AS h,
    (p_partkey % 13) * 0.5e0 AS yaw, p_type AS label FROM part),
  b AS (SELECT *, l * 0.5e0 + 0.05e0 AS hx, w * 0.5e0 + 0.05e0 AS hy, h * 0.5e0 + 0.05e0 AS hz,
    CASE WHEN abs(yaw) >= 1e-12 THEN cos(-yaw) ELSE 1.0e0 END AS c, CASE WHEN abs(yaw) >= 1e-12 THEN sin(-yaw) ELSE 0.0e0 END AS s FROM raw_b)"""
INSIDE_SQL = """b.frame_id = p.frame_id AND abs(b.c * (p.x - b.cx) - b.s * (p.y - b.cy)) <= b.hx
    AND abs(b.s * (p.x - b.cx) + b.c * (p.y - b.cy)) <= b.hy AND abs(p.z - b.cz) <= b.hz"""
CROPPED_SQL = f"{POINTS_SQL}, {BOXES_SQL}, m AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM b WHERE {INSIDE_SQL}) AS keep FROM p)"
_CELLS = ", ".join(f"CAST(floor({a} / {VOXEL}e0) AS BIGINT) AS v{a}" for a in "xyz")
VOXELS_SQL = f"""v AS (SELECT *, {_CELLS} FROM p),
  f AS (SELECT frame_id, dense_rank() OVER (ORDER BY frame_id) AS frame_seq FROM (SELECT DISTINCT frame_id FROM p))"""
PERSISTENT_SQL = f"""{POINTS_SQL}, {VOXELS_SQL},
  h AS (SELECT frame_id, vx, vy, vz, count(*) OVER (PARTITION BY vx, vy, vz ORDER BY frame_seq RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hits
        FROM (SELECT DISTINCT frame_id, vx, vy, vz FROM v) JOIN f USING (frame_id)),
  m AS (SELECT v.*, h.hits >= {HITS} AS keep FROM v JOIN h USING (frame_id, vx, vy, vz))"""
CUMULATIVE_SQL = f"""{PERSISTENT_SQL},
  fr AS (SELECT seq, count(*) AS n FROM (SELECT min(frame_seq) AS seq FROM m JOIN f USING (frame_id) GROUP BY vx, vy, vz) GROUP BY seq),
  fc AS (SELECT seq, count(*) AS n FROM (SELECT min(frame_seq) AS seq FROM m JOIN f USING (frame_id) WHERE keep GROUP BY vx, vy, vz) GROUP BY seq),
  t AS (SELECT f.frame_id, f.frame_seq, CAST(sum(coalesce(fr.n, 0)) OVER (ORDER BY frame_seq) AS BIGINT) AS raw, CAST(sum(coalesce(fc.n, 0)) OVER (ORDER BY frame_seq) AS BIGINT) AS clean
        FROM f LEFT JOIN fr ON fr.seq = f.frame_seq LEFT JOIN fc ON fc.seq = f.frame_seq),
  cv AS (SELECT *, raw - clean AS ghost, 100.0e0 * (raw - clean) / greatest(1, raw) AS ghost_pct FROM t)"""
BEV_SQL = f"""{PERSISTENT_SQL},
  clean AS (SELECT vx, vy, count(*) AS cells FROM (SELECT DISTINCT vx, vy, vz FROM m WHERE keep) GROUP BY vx, vy),
  ghost AS (SELECT vx, vy, count(*) AS cells FROM (SELECT DISTINCT vx, vy, vz FROM m EXCEPT SELECT DISTINCT vx, vy, vz FROM m WHERE keep) GROUP BY vx, vy)"""
