"""Command lines: crop a cloud, show a scan or a sequence, measure the filters, run them on streams, and make up frames."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.crop import MARGIN, drop_small_boxes, mark_points, summarise
from .operators.frames import latency, throughput
from .operators.temporal import MIN_HITS, VOXEL_SIZE, WINDOW_SIZE, keep_persistent
from .sources.boxes import read_boxes, read_poses
from .sources.points import read_points
from .sources.sinks import summary, write_points, write_summary
from .streaming.boxes import HISTORY, STALE_TIME

CLOUD_FORMATS = ("auto", "csv", "pcd", "text", "npy", "bin", "feather")
BOX_FORMATS = ("auto", "json", "csv", "kitti", "av2")
#: Flags and their settings, by topic. The names and defaults are the interface of the tools. Fixed values.
FLAGS = {
    "cloud": {"--input-cloud": {"required": True}, "--cloud-format": {"default": "auto", "choices": CLOUD_FORMATS}},
    "boxes": {"--objects-format": {"default": "auto", "choices": BOX_FORMATS}, "--calib-path": {}, "--timestamp-ns": {"type": int}, "--skip-invalid": {"action": "store_true"}, "--min-size": {"type": float, "default": 0.01}},
    "margin": {"--box-margin": {"nargs": 3, "type": float, "default": list(MARGIN), "metavar": ("X", "Y", "Z")}},
    "voxels": {"--voxel-size": {"type": float, "default": VOXEL_SIZE}, "--temporal-window": {"type": int, "default": WINDOW_SIZE}, "--temporal-min-hits": {"type": int, "default": MIN_HITS}},
    "algorithm": {"--algorithm": {"default": "box", "choices": ("box", "temporal")}},
}


class CommandError(Exception):
    """What a user can mend; it ends the command with its text."""


def session() -> SparkSession:
    return SparkSession.builder.appName("voxelgate").config("spark.sql.session.timeZone", "UTC").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()


def _parser(about: str, *topics: str, **more: dict) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--version", action="version", version=f"voxelgate {__version__}")
    for flags in (*(FLAGS[t] for t in topics), {f"--{k.replace('_', '-')}": v for k, v in more.items()}):
        for name, settings in flags.items():
            p.add_argument(name, **settings)
    return p


@dataclass
class Scan:
    """One cloud and its boxes, both as frame 0."""

    points: DataFrame
    boxes: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, a: argparse.Namespace) -> Scan:
        for path in filter(None, (a.input_cloud, a.input_objects)):
            if not Path(path).exists():
                raise CommandError(f"there is no {path}")
        frame = F.lit("0").alias("frame_id")
        if a.input_objects:
            boxes = drop_small_boxes(read_boxes(spark, a.input_objects, fmt=a.objects_format, skip_invalid=a.skip_invalid, calib_path=a.calib_path, timestamp_ns=a.timestamp_ns), a.min_size)
        else:
            boxes = spark.createDataFrame([], "box_id long, cx double, cy double, cz double, l double, w double, h double, yaw double, label string")
        return cls(read_points(spark, a.input_cloud, fmt=a.cloud_format).select("*", frame), boxes.select("*", frame))

    def marked(self, a: argparse.Namespace) -> DataFrame:
        return mark_points(self.points, self.boxes, tuple(a.box_margin))


def crop(argv: Sequence[str]) -> None:
    a = _parser("Remove the points of a cloud that are in boxes.", "cloud", "boxes", "margin", input_objects={"required": True}, output_cloud={"required": True}, summary_json={}, quiet={"action": "store_true"}).parse_args(argv)
    scan = Scan.read(session(), a)
    marked = scan.marked(a).cache()
    report = summary(summarise(marked), scan.boxes)
    Path(a.output_cloud).parent.mkdir(parents=True, exist_ok=True)
    write_points(marked.filter("keep"), a.output_cloud, fmt=a.cloud_format)
    marked.unpersist()
    if a.summary_json:
        write_summary(a.summary_json, report)
    if not report["objects"]:
        print("there are no boxes, so all points stay", file=sys.stderr)
    if not a.quiet:
        print(f"{report['removed_points']} of {report['total_points']} points in {len(report['objects'])} boxes removed ({report['removed_ratio']:.2%}); {report['kept_points']} written to {a.output_cloud}", file=sys.stderr)


def scan(argv: Sequence[str]) -> None:
    from .plans.scene import scan_document

    a = _parser("Write the document of one scan.", "cloud", "boxes", "margin", input_objects={}, output_scene={"required": True}, max_render_points={"type": int, "default": 20_000}, random_seed={"type": int, "default": 7}).parse_args(argv)
    s = Scan.read(session(), a)
    if s.points.isEmpty():
        raise CommandError(f"{a.input_cloud} has no points")
    text = scan_document(s.points, s.boxes, a.input_cloud, a.max_render_points, a.random_seed, tuple(a.box_margin)).first()["document"]
    Path(a.output_scene).parent.mkdir(parents=True, exist_ok=True)
    Path(a.output_scene).write_text(text, encoding="utf-8")


def sequence(argv: Sequence[str]) -> None:
    from .operators.align import frame_timestamp
    from .operators.frames import slice_frames
    from .plans.scene import accumulate, document, write_scene
    from .sources.boxes import boxes_for_frames

    whole = {"type": int}
    p = _parser("Accumulate a sequence of clouds and write its scene.", "margin", input_glob={"required": True}, cloud_format=FLAGS["cloud"]["--cloud-format"], objects={}, pose_path={}, output_json={}, output_folder={}, start=whole | {"default": 0}, frames=whole, stride=whole | {"default": 1}, voxel_size=FLAGS["voxels"]["--voxel-size"], window_size=whole | {"default": WINDOW_SIZE}, min_hits=whole | {"default": MIN_HITS}, max_points=whole | {"default": 2500})
    a = p.parse_args(argv)
    if not a.output_json and not a.output_folder:
        raise CommandError("give --output-json, or --output-folder for long sequences")
    spark = session()
    every = read_points(spark, a.input_glob, fmt=a.cloud_format)
    chosen = slice_frames(every.select("path").distinct(), a.start, a.frames, a.stride).drop("index")
    stamp = frame_timestamp(F.col("path"))
    points = every.join(chosen, "path").withColumns({"frame_id": F.col("path"), "timestamp_ns": stamp}).drop("path")
    boxes = boxes_for_frames(spark, chosen.withColumn("timestamp_ns", stamp), a.objects).withColumnRenamed("path", "frame_id") if a.objects else None
    run = accumulate(points, boxes, read_poses(spark, a.pose_path) if a.pose_path else None, a.voxel_size, a.window_size, a.min_hits, tuple(a.box_margin))
    if a.output_json:
        Path(a.output_json).write_text(document(run, a.max_points).first()["document"], encoding="utf-8")
    if a.output_folder:
        write_scene(run, a.output_folder, a.max_points)


def measure(argv: Sequence[str]) -> None:
    """Times a filter on one cloud; the first run is a warm-up. The persistence filter sees the cloud again and again, as in a standing scene."""
    a = _parser("Measure a filter on one cloud.", "cloud", "boxes", "margin", "voxels", "algorithm", input_objects={}, iterations={"type": int, "default": 200}, summary_json={}, output_cloud={}).parse_args(argv)
    if a.algorithm == "box" and not a.input_objects:
        raise CommandError("the box algorithm needs --input-objects")
    spark, rounds = session(), max(1, a.iterations)
    given = Scan.read(spark, a)
    points = given.points.cache()
    total, times = points.count(), []

    def filtered(i: int) -> DataFrame:
        if a.algorithm == "box":
            return given.marked(a)
        recent = spark.range(max(0, i - a.temporal_window + 1), i + 1).withColumnRenamed("id", "frame_id")
        marked = keep_persistent(points.drop("frame_id").crossJoin(F.broadcast(recent)), a.voxel_size, a.temporal_window, a.temporal_min_hits)
        return marked.filter(F.col("frame_id") == i)

    for i in range(rounds + 1):
        began = time.perf_counter()
        kept = filtered(i).agg(F.count_if("keep")).first()[0]
        if i:
            times.append(((time.perf_counter() - began) * 1000.0,))
    figures = latency(spark.createDataFrame(times, "ms double"))
    speed = figures.select(throughput(F.lit(float(max(1, total))), F.col("mean_ms"))).first()[0]
    report = {"algorithm": a.algorithm, "iterations": rounds, "input_points": total, "output_points_last": kept, "removed_points_last": total - kept, "removed_ratio_last": (total - kept) / total if total else 0.0}
    report |= {f"elapsed_ms_{k.removesuffix('_ms')}": v for k, v in figures.first().asDict().items()} | {"throughput_kpps_mean": speed}
    text = json.dumps({"summary": report}, indent=2)
    print(text)
    if a.summary_json:
        Path(a.summary_json).write_text(text, encoding="utf-8")
    if a.output_cloud:
        write_points(filtered(rounds).filter("keep"), a.output_cloud)


def stream(argv: Sequence[str]) -> None:
    """Topics are folders of Parquet files: packed clouds (or points, for the persistence filter), and box messages."""
    from .streaming import pipeline
    from .streaming.temporal import use_rocksdb

    p = _parser("Filter a stream of clouds.", "margin", "voxels", "algorithm", pointcloud_topic={"required": True}, objects_topic={}, output_topic={"required": True}, checkpoint={"required": True}, min_size={"type": float, "default": 0.01}, box_stale_time={"type": float, "default": STALE_TIME}, max_object_history={"type": int, "default": HISTORY}, queue_size={"type": int, "default": 20}, stats_period={"type": int, "default": 100}, quiet={"action": "store_true"}, summary_json={}, once={"action": "store_true"})
    a = p.parse_args(argv)
    if a.algorithm == "box" and not a.objects_topic:
        raise CommandError("the box algorithm needs --objects-topic")
    spark = session()
    use_rocksdb(spark)
    read = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", a.queue_size).parquet(path)
    figures = pipeline.RunFigures(None if a.quiet else lambda f: print(dict(f), file=sys.stderr), a.stats_period, f"{a.checkpoint}/figures")
    sink = pipeline.publish(a.output_topic)
    if a.algorithm == "box":
        run = pipeline.run_boxes(read(a.pointcloud_topic), read(a.objects_topic), sink, a.checkpoint, figures, tuple(a.box_margin), a.min_size, a.box_stale_time, max(1, a.max_object_history), a.once)
    else:
        run = pipeline.run_persistence(read(a.pointcloud_topic), sink, a.checkpoint, figures, a.voxel_size, a.temporal_window, a.temporal_min_hits, a.once)
    try:
        run.awaitTermination()
    finally:
        if a.summary_json:
            figures.write(spark, a.summary_json)


def synthetic(argv: Sequence[str]) -> None:
    from .sources.synthetic import write_frames

    a = _parser("Write made-up frames with labels and calibrations.", output_folder={"required": True}, frames={"type": int, "default": 5}, seed={"type": int, "default": 42}).parse_args(argv)
    write_frames(session(), a.output_folder, a.frames, a.seed)


COMMANDS = {f.__name__: f for f in (crop, scan, sequence, measure, stream, synthetic)}


def main(argv: Sequence[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else list(argv)
    if not argv or argv[0] not in COMMANDS:
        print(f"usage: voxelgate {{{','.join(COMMANDS)}}} ...", file=sys.stderr)
        return 2
    try:
        COMMANDS[argv[0]](argv[1:])
    except CommandError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
