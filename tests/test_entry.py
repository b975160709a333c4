import importlib.util
import json

import duckdb
import pytest

import __spark_entry__ as entry
from voxelgate import cli

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
HEADLINES = ("jon_06_annotations", "src_05_pcd_ascii", "src_10_feather", "src_13_json_boxes", "src_15_kitti_labels", "src_20_frame_boxes", "snk_08_scene_document", "sca_message_payload", "str_04_box_selection", "agg_13_run_figures", "udx_03_clusters", "jon_01_box_crop", "jon_02_keep_mask", "win_01_temporal", "win_02_ghost_cumulative", "jon_07_asof_nearest", "jon_09_bev_outer", "srt_05_preserved", "agg_18_crop_stats", "sca_json_payload", "prj_05_pose_boxes")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", HEADLINES)
def test_queries_match_their_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    want = oracle.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("voxelgate.llm") is None:
        assert not any(k.startswith("op") for k in entry.queries())


def test_crop_command(spark, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("x,y,z\n0,0,0\n5,5,5\n")
    (tmp_path / "b.json").write_text(json.dumps([{"center": [0, 0, 0], "size": [1, 1, 1], "label": "car"}]))
    args = ["crop", "--input-cloud", str(tmp_path / "c.csv"), "--input-objects", str(tmp_path / "b.json"), "--output-cloud", str(tmp_path / "o" / "out.csv"), "--summary-json", str(tmp_path / "s.json")]
    assert cli.main(args) == 0
    report = json.loads((tmp_path / "s.json").read_text())
    assert (report["total_points"], report["kept_points"], report["removed_points"], report["removed_ratio"]) == (2, 1, 1, 0.5)
    assert report["objects"] == [{"label": "car", "center": [0, 0, 0], "size": [1, 1, 1], "yaw": 0}]
    assert (tmp_path / "o" / "out.csv").read_text().splitlines() == ["x,y,z", "5.0000000000,5.0000000000,5.0000000000"]
    assert "1 of 2 points in 1 boxes removed (50.00%)" in capsys.readouterr().err
    assert cli.main([*args[:2], str(tmp_path / "none"), *args[3:]]) == 1 and cli.main(["what"]) == 2


def test_sequence_command(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{100 + i}.csv").write_text("x,y,z\n" + "".join(f"{k % 5},{k // 5},{i % 2}\n" for k in range(25)))
    (tmp_path / "b.json").write_text(json.dumps({"101.csv": [{"center": [0, 0, 1], "size": [1, 1, 1]}]}))
    out = tmp_path / "scene.json"
    assert cli.main(["sequence", "--input-glob", str(tmp_path / "1*.csv"), "--objects", str(tmp_path / "b.json"), "--output-json", str(out), "--voxel-size", "1"]) == 0
    doc = json.loads(out.read_text())
    assert doc["meta"] == {"input_points": 75, "kept_points": 74, "removed_points": 1, "frame_count": 3}


def test_scan_measure_and_stream_commands(spark, tmp_path, capsys):
    assert cli.main(["synthetic", "--output-folder", str(tmp_path), "--frames", "2"]) == 0
    cloud, labels, calib = (str(tmp_path / d / f"000001.{s}") for d, s in (("velodyne", "bin"), ("label_2", "txt"), ("calib", "txt")))
    boxes = ["--input-objects", labels, "--objects-format", "kitti", "--calib-path", calib]
    assert cli.main(["scan", "--input-cloud", cloud, *boxes, "--output-scene", str(tmp_path / "s" / "scan.json"), "--max-render-points", "20"]) == 0
    doc = json.loads((tmp_path / "s" / "scan.json").read_text())
    assert doc["meta"]["input_points"] == 5500 and doc["meta"]["removed_points"] >= 500 and doc["meta"]["objects"] == 1 and doc["box"]["label"] == "Car"
    assert [len(doc["points"][k]) for k in ("input", "kept", "removed")] == [20, 20, 20] and doc["limits"]["box_half"] == [2.25, 0.9, 0.75]
    assert cli.main(["scan", "--input-cloud", cloud, "--output-scene", str(tmp_path / "bare.json")]) == 0
    bare = json.loads((tmp_path / "bare.json").read_text())
    assert bare["box"] == {"center": [0, 0, 0], "size": [0, 0, 0], "yaw": 0, "label": "scan"} and bare["objects"] == [] and bare["meta"]["removed_points"] == 0
    capsys.readouterr()
    for extra, removed in ((boxes, doc["meta"]["removed_points"]), (["--algorithm", "temporal", "--voxel-size", "0.5"], 0)):
        assert cli.main(["measure", "--input-cloud", cloud, *extra, "--iterations", "3", "--output-cloud", str(tmp_path / "kept.csv")]) == 0
        report = json.loads(capsys.readouterr().out)["summary"]
        assert report["removed_points_last"] == removed and report["iterations"] == 3 and report["elapsed_ms_min"] > 0 and report["throughput_kpps_mean"] > 0
        assert len((tmp_path / "kept.csv").read_text().splitlines()) == 5501 - removed
    assert cli.main(["measure", "--input-cloud", cloud]) == 1 and cli.main(["stream", "--pointcloud-topic", "x", "--output-topic", "y", "--checkpoint", "z"]) == 1
    rows = [("a", f, i, float(i), 0.0, 0.0) for f in range(3) for i in range(5)]
    spark.createDataFrame(rows, "sensor string, frame_seq long, point_id long, x double, y double, z double").write.parquet(str(tmp_path / "in"))
    args = ["--algorithm", "temporal", "--voxel-size", "1", "--temporal-min-hits", "2", "--once", "--quiet"]
    assert cli.main(["stream", "--pointcloud-topic", str(tmp_path / "in"), "--output-topic", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "c"), "--summary-json", str(tmp_path / "f.json"), *args]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10 and json.loads((tmp_path / "f.json").read_text())["removed_points"] == 5


def test_sequence_with_other_sources_of_boxes(spark, tmp_path):
    for i in (101, 102):
        (tmp_path / f"{i}.csv").write_text("x,y,z\n0,0,0\n5,5,5\n")
    (tmp_path / "b.txt").write_text("x,y,z,length,width,height\n0,0,0,1,1,1\n")
    assert cli.main(["sequence", "--input-glob", str(tmp_path / "10*.csv"), "--objects", str(tmp_path / "b.txt"), "--output-json", str(tmp_path / "o.json"), "--output-folder", str(tmp_path / "o"), "--voxel-size", "1"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["meta"]["removed_points"] == 2
    assert spark.read.json(str(tmp_path / "o" / "frames")).count() == 2 and spark.read.json(str(tmp_path / "o" / "cells")).count() == 2
