"""A running filter: clouds and box messages in, cropped or persistent clouds out, with figures of the frames."""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.crop import MARGIN, mark_points
from ..operators.frames import latency
from ..sources import files
from ..sources.pointcloud2 import FIELDS, PART, decode, encode_parts, join_parts
from ..sources.topics import append_topic
from .boxes import HISTORY, STALE_TIME, parsed_boxes, read_messages, select_boxes
from .temporal import BUCKETS, filter_stream

#: Frames whose times are kept.
LATEST = 4096
#: Takes what a micro-batch gives and the micro-batch's number, by which a repeated one is known.
Sink = Callable[[DataFrame, int], None]


def publish(path: str) -> Sink:
    """A folder of Parquet files with a folder for each micro-batch; one that is repeated after a failure replaces itself."""
    return lambda out, number: out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def publish_topic(path: str, producer: str) -> Sink:
    """A topic with an entry for each micro-batch; one that is repeated finds its entry. producer: the run's checkpoint."""
    return lambda out, number: append_topic(out, path, number, producer)


class RunFigures:
    """What a run has done so far: totals of its micro-batches, and the times of the latest frames.

    With a folder, which has to be in a file system that the driver can open, each micro-batch
    leaves the totals up to it under its number, counted from those of the micro-batch before. So a
    repeated one isn't counted twice, and a run that is started again counts on.
    """

    def __init__(self, report: Callable[[dict], None] | None = None, period: int = 100, folder: str | None = None):
        self.report, self.period, self.folder = report, max(1, period), folder
        self.totals: Counter = Counter()
        self.times: list[float] = []
        if folder:
            self._restore()

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.folder) if n.endswith(".json")]

    def _restore(self, before: int | None = None) -> None:
        """The totals of the last micro-batch, or of the last one before a number."""
        known = [n for n in self._numbers() if before is None or n < before]
        held = json.loads(files.read_bytes(self._path(max(known)))) if known else {"totals": {}, "times": []}
        self.totals, self.times = Counter(held["totals"]), held["times"]

    def add(self, figures: dict[str, int], times: list[float], number: int | None = None) -> None:
        """figures and the milliseconds of its latest frames, of one micro-batch."""
        if self.folder and number is not None:
            self._restore(number)
        before = self.totals["frames"] // self.period
        self.totals.update(figures)
        self.times = [*self.times, *times][-LATEST:]
        if self.folder and number is not None:
            files.write_whole(self._path(number), json.dumps({"totals": self.totals, "times": self.times}).encode())
            # the one before is what a repetition of this one counts from
            for old in sorted(self._numbers())[:-2]:
                files.delete(self._path(old))
        if self.report and self.totals["frames"] // self.period > before:
            self.report(self.totals | {"ms": times[-1] if times else None})

    def summary(self, spark) -> dict:
        """Totals, the share of points removed, and the latencies. A frame that no box was used for counts as stale, whatever the reason."""
        t = {k: self.totals[k] for k in ("frames", "input_points", "output_points", "boxes_received", "frames_with_boxes")}
        removed, without = t["input_points"] - t["output_points"], t["frames"] - t["frames_with_boxes"]
        t |= {"removed_points": removed, "removed_ratio": removed / t["input_points"] if t["input_points"] else 0.0, "frames_without_boxes": without, "stale_box_frames": without}
        times = latency(spark.createDataFrame([(x,) for x in self.times], "ms double")).first().asDict()
        return t | {k: times[k] for k in ("mean_ms", "p50_ms", "p95_ms", "max_ms")}

    def write(self, spark, path: str) -> None:
        Path(path).write_text(json.dumps(self.summary(spark), indent=2), encoding="utf-8")


def crop_clouds(batch: DataFrame, margin: tuple[float, float, float] = MARGIN) -> DataFrame:
    """Points (cloud_id, part, point_id, x, y, z, keep) of clouds with their boxes, as select_boxes carries them."""
    packed = batch.filter("cloud IS NOT NULL").select(F.col("cloud_id").cast("string").alias("frame_id"), "cloud.*")
    points = decode(packed).withColumnRenamed("frame_id", "cloud_id").withColumn("cloud_id", F.col("cloud_id").cast("long"))
    if "part" not in points.columns:
        points = points.withColumn("part", F.expr(f"point_id DIV {PART}"))
    return mark_points(points, parsed_boxes(batch.filter("NOT stale")), margin, "cloud_id")


def cloud_figures(batch: DataFrame, out: DataFrame) -> DataFrame:
    """One row of sums over a micro-batch and the clouds that go out. Boxes are used for a cloud that has points and boxes in time."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    points = F.greatest("cloud.width", F.lit(0)).cast("long") * F.greatest("cloud.height", F.lit(0))
    counted = batch.filter("cloud IS NOT NULL").groupBy("cloud_id").agg(F.sum(points).alias("n"))
    rows = batch.filter("cloud IS NULL AND piece = 0").select("cloud_id", "has_boxes", "stale").join(counted, "cloud_id", "left")
    cloud = F.col("cloud_id").isNotNull()
    row = rows.agg(F.count_if(cloud).alias("frames"), total("n").alias("input_points"), F.count_if(~cloud).alias("boxes_received"), F.count_if(cloud & F.col("has_boxes") & ~F.col("stale") & (F.col("n") > 0)).alias("frames_with_boxes"))
    return row.crossJoin(out.agg(total("width").alias("output_points")))


def _step(work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sink: Sink, figures: RunFigures, arrivals: Callable[[DataFrame], DataFrame] | None):
    """arrivals: of a micro-batch, the seconds (arrived) at which its frames came; without it a frame's time is its share of the micro-batch's."""

    def step(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        held = out = batch.persist()
        try:
            out, row = work(held)
            sink(out, number)
            counted = row.first().asDict()
            if arrivals is None:
                n = counted["frames"]
                times = [(time.perf_counter() - began) * 1000.0 / max(1, n)] * min(n, LATEST)
            else:
                now = time.time()
                latest = arrivals(held).orderBy(F.desc("arrived")).limit(LATEST).collect()
                times = [(now - r["arrived"]) * 1000.0 for r in reversed(latest)]
            figures.add(counted, times, number)
        finally:
            out.unpersist()
            held.unpersist()

    return step


def run_boxes(clouds: DataFrame, messages: DataFrame, sink: Sink, checkpoint: str, figures: RunFigures, margin: tuple[float, float, float] = MARGIN, min_size: float = 0.01, stale_time: float = STALE_TIME, history: int = HISTORY, once: bool = False, live: bool = False) -> StreamingQuery:
    """Crops a stream of clouds by the boxes of a stream of messages, and hands the cropped clouds to sink batch by batch, with the batch's number.

    clouds: sensor, cloud_id, arrival, stamp and the fields of a packed cloud; messages as of
    read_messages. sink gets packed clouds named by cloud_id; a cloud without boxes in time goes
    out as it came. Clouds with a column part come in parts, all of them in one micro-batch, and go
    out so; messages may do so too, as of select_boxes. live: arrival is in seconds of the driver's
    clock, and a frame's time runs from there until it is out.
    """
    parted = "part" in clouds.columns
    packed = clouds.withColumn("cloud", F.struct(*FIELDS, *([F.col("part").cast("long").alias("part")] if parted else [])))
    chosen = select_boxes(packed, read_messages(messages, min_size), stale_time, history, carry=True)

    def work(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        # the first job computes the micro-batch in one stage, so that its state isn't written by several
        lost = batch.filter("cloud_id IS NOT NULL").groupBy("cloud_id").agg(F.bool_and(F.col("cloud").isNotNull()).alias("bare")).filter("bare").first()
        if lost:
            raise ValueError(f"parts of the cloud {lost['cloud_id']} came without its head")
        heads = batch.filter("cloud IS NULL AND piece = 0 AND cloud_id IS NOT NULL").select("cloud_id")
        name = F.col("cloud_id").cast("string").alias("frame_id")
        parts = encode_parts(crop_clouds(batch, margin).filter("keep").select(name, "part", "point_id", "x", "y", "z"), heads.select(name))
        out = (parts if parted else join_parts(parts)).persist()
        return out, cloud_figures(batch, out)

    arrived = (lambda batch: batch.filter("cloud IS NULL AND piece = 0 AND cloud_id IS NOT NULL").select(F.col("arrival").alias("arrived"))) if live else None
    return _start(chosen, _step(work, sink, figures, arrived), checkpoint, once)


def run_persistence(points: DataFrame, sink: Sink, checkpoint: str, figures: RunFigures, voxel_size: float, window_size: int, min_hits: int, once: bool = False, late: str = "0 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """The persistence filter on a stream of points, as filter_stream takes it; sink gets the points of closed frames that stay."""

    def work(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        row = batch.agg(F.count_distinct("sensor", "frame_seq").alias("frames"), F.count(F.lit(1)).alias("input_points"), F.count_if("keep").alias("output_points"))
        return batch.filter("keep").drop("keep"), row

    return _start(filter_stream(points, voxel_size, window_size, min_hits, late, buckets), _step(work, sink, figures, None), checkpoint, once)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
