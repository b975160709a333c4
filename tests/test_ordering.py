"""Running sums, ranks, exact percentiles, components and samples against plain Python, dealt out as many rows would be."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgate.operators import components, frames, ordering


@pytest.mark.parametrize("small", [0, 1000])
def test_running_sums_and_ranks(spark, small):
    rng = random.Random(4)
    rows = [(f"f{i:04d}", rng.randrange(5), None if i % 7 == 0 else i) for i in range(300)]
    given = spark.createDataFrame(random.Random(1).sample(rows, 300), "path string, a long, b long").repartition(5)
    out, n = ordering.running(given, "path", {"sa": "a", "sb": "b"}, small=small)
    got = [tuple(r) for r in out.select("path", "sa", "sb").orderBy("path").collect()]
    sa = np.cumsum([r[1] for r in rows]).tolist()
    sb = np.cumsum([r[2] or 0 for r in rows]).tolist()
    assert n == 300 and got == [(r[0], x, y) for r, x, y in zip(rows, sa, sb, strict=True)]
    places = {r.path: r.place for r in ordering.ranked(given, "path", "place", 0, small=small)[0].collect()}
    assert places == {r[0]: i for i, r in enumerate(rows)}
    empty, n = ordering.ranked(given.limit(0), "path", "place", small=small)
    assert n == 0 and empty.count() == 0


def test_many_ranks_meet_in_no_single_task(spark):
    given = spark.createDataFrame([(i,) for i in range(100)], "n long").repartition(4)
    plan = ordering.ranked(given, "n", "place", small=0)[0]._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


VALUES = {
    "plain": [float(x) for x in np.random.default_rng(2).normal(size=3000)],
    "ties": [float(x % 3) for x in range(2000)],
    "one": [7.5] * 500,
    "wide": [10.0 ** (x % 300) * (-1) ** x for x in range(1500)],
    "ends": [-1.7e308, 1.7e308, 0.0, 5e-324] * 40,
    "few": [2.0, 1.0],
}


@pytest.mark.parametrize("name", VALUES)
def test_percentiles(spark, name):
    values = VALUES[name]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    shares = [0.0, 0.01, 0.5, 0.95, 0.999, 1.0]
    want = rows.agg(F.percentile("v", shares)).first()[0]
    assert ordering.percentiles(rows, "v", shares, small=10) == pytest.approx(want, rel=1e-12)
    assert ordering.percentiles(rows, "v", shares) == pytest.approx(want, rel=1e-12)
    assert ordering.percentiles(rows.limit(0), "v", shares, small=0) == [None] * 6


def plain_components(cells):
    left, out = set(cells), {}
    while left:
        start = left.pop()
        group, todo = {start}, [start]
        while todo:
            x, y = todo.pop()
            for c in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if c in left:
                    left.remove(c)
                    group.add(c)
                    todo.append(c)
        least = min(cells[c] for c in group)
        out |= dict.fromkeys(group, least)
    return out


@pytest.mark.parametrize("few", [1000, 0])
def test_components_across_tiles(spark, few):
    """Blobs, a spiral through many tiles, and negative places; joined in tasks or by rounds."""
    rng = random.Random(3)
    spiral = [(x, 0) for x in range(-20, 20)] + [(19, y) for y in range(0, 30)] + [(x, 29) for x in range(-18, 20)] + [(-18, y) for y in range(4, 30)] + [(x, 4) for x in range(-18, 14)]
    by_frame = {0: {(rng.randrange(-25, 25), rng.randrange(-25, 25)) for _ in range(500)}, 1: set(spiral), 2: {(0, 0), (7, 8), (8, 7), (100, -100)}}
    rows, want = [], {}
    for frame, cells in by_frame.items():
        names = dict(zip(sorted(cells), rng.sample(range(10_000), len(cells)), strict=True))
        rows += [(frame, x, y, n, "kept") for (x, y), n in names.items()]
        want |= {(frame, *c): k for c, k in plain_components(names).items()}
    cells = spark.createDataFrame(rows, "frame_id int, gx long, gy long, first long, more string").repartition(3)
    found = components.connect_cells(cells, tile=8, few=few, few_cells=0)
    assert found.columns == [*cells.columns, "component"]
    assert {(r.frame_id, r.gx, r.gy): r.component for r in found.collect()} == want
    assert {(r.frame_id, r.gx, r.gy): r.component for r in components.connect_cells(cells).collect()} == want
    assert components.connect_cells(cells.limit(0), tile=8, few=few).count() == 0
    assert {r.component for r in components.connect_cells(cells.filter("frame_id = 2 AND gx = 0")).collect()} == {n for f, x, _, n, _ in rows if f == 2 and x == 0}


def test_no_task_holds_a_frame(spark):
    cells = spark.range(400).selectExpr("0 AS frame_id", "id % 20 AS gx", "id div 20 AS gy", "id AS first")
    tiled = components._within_tiles(cells, "frame_id", "first", 8)
    assert max(r["count"] for r in tiled.groupBy("_tx", "_ty").count().collect()) == 64
    assert re.search(r"hashpartitioning\(frame_id#\d+, _tx#\d+L?, _ty", tiled._jdf.queryExecution().executedPlan().toString())


def test_samples_order_little_more_than_they_take(spark, monkeypatch):
    points = spark.range(20_000).selectExpr("id AS point_id", "CAST(id % 2 AS INT) AS frame_id").unionByName(spark.range(3).selectExpr("id AS point_id", "9 AS frame_id"))
    asked = []
    whole = frames.checkpoint
    monkeypatch.setattr(frames, "checkpoint", lambda df: asked.append(whole(df)) or asked[-1])
    got = frames.sample_each_frame(points, 100, 7)
    assert {r.frame_id: r["count"] for r in got.groupBy("frame_id").count().collect()} == {0: 100, 1: 100, 9: 3}
    assert asked[1].count() < 2 * 203
    first = [r.point_id for r in points.filter("frame_id = 1").orderBy(frames.sample_order("point_id", 7)).limit(100).collect()]
    assert {r.point_id for r in got.filter("frame_id = 1").collect()} == set(first)


def test_a_sample_below_its_bound_is_taken_whole(spark, monkeypatch):
    """A hash that puts all points of a frame above the bound leaves none; the frame is ordered whole then."""
    points = spark.range(1000).selectExpr("id AS point_id", "1 AS frame_id")
    monkeypatch.setattr(frames, "sample_order", lambda key, seed: F.concat(F.lit("ffffffff"), F.lpad(F.col(key).cast("string"), 6, "0")))
    assert sorted(r.point_id for r in frames.sample_each_frame(points, 5, 7).collect()) == [0, 1, 2, 3, 4]
