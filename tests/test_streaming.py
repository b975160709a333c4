import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelgate.functions.payload import document, message_stamp, parse_boxes
from voxelgate.operators.temporal import keep_persistent
from voxelgate.sources import pointcloud2, topics
from voxelgate.streaming import pipeline
from voxelgate.streaming.boxes import BoxBuffer, Message, parsed_boxes, read_messages, select_boxes
from voxelgate.streaming import temporal
from voxelgate.streaming.temporal import PersistenceWindow, filter_stream

FRAME = "sensor string, frame_seq long, point_id long, x double, y double, z double"


def run(stream, spark, name, checkpoint):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def dealt_out(spark, folder, parts):
    """A folder whose files hold the given rows, in the order in which a stream takes them."""
    (folder / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FRAME).coalesce(1).write.parquet(str(folder / "t"), mode="overwrite")
        (file,) = [p for p in (folder / "t").iterdir() if p.suffix == ".parquet"]
        file.rename(folder / "in" / f"{i}.parquet")
        os.utime(folder / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def in_batch(spark, rows, voxel, window, hits):
    want = {}
    for s in {r[0] for r in rows}:
        points = spark.createDataFrame([r for r in rows if r[0] == s], FRAME).withColumnRenamed("frame_seq", "frame_id")
        want |= {(s, r.frame_id, r.point_id): r.keep for r in keep_persistent(points, voxel, window, hits).collect()}
    return want


def some_points(sensors, frames, n):
    rng = np.random.default_rng(9)
    return [(s, f, i, *map(float, rng.uniform(0, 3, 3))) for s in sensors for f in frames for i in range(n)]


END = ("b", 99, None, None, None, None)


def test_stream_equals_batch(spark, tmp_path):
    """Frame after frame; the fourth has no points for one of the sensors, which doesn't move that sensor's window."""
    rows = [r for r in some_points("ab", range(7), 30) if (r[0], r[1]) != ("a", 3)]
    stream = dealt_out(spark, tmp_path, [*([r for r in rows if r[1] == f] for f in range(7)), [END]])
    got = {(r.sensor, r.frame_seq, r.point_id): r.keep for r in run(filter_stream(stream, 1.0, 3, 2, buckets=5), spark, "kept", tmp_path / "c")}
    assert got == in_batch(spark, rows, 1.0, 3, 2) and 0 < sum(got.values()) < len(got)


def test_frames_over_several_batches_out_of_order(spark, tmp_path):
    """Each frame comes in three micro-batches, mixed with the next two frames, the later points first."""
    rows = some_points("a", range(6), 30)
    parts = [[] for _ in range(10)]
    for r in rows:
        parts[r[1] + (29 - r[2]) % 3].insert(0, r)
    stream = dealt_out(spark, tmp_path, [*[p for p in parts if p], [END]])
    got = {(r.sensor, r.frame_seq, r.point_id): r.keep for r in run(filter_stream(stream, 1.0, 3, 2, late="3 seconds", buckets=4), spark, "mixed", tmp_path / "c")}
    assert got == in_batch(spark, rows, 1.0, 3, 2) and 0 < sum(got.values()) < len(got)


def test_points_after_their_frame_was_closed_are_dropped(spark, tmp_path):
    a = [("a", f, 0, 0.5, 0.5, 0.5) for f in range(4)]
    stream = dealt_out(spark, tmp_path, [a[:2], a[2:3], [("a", 0, 7, 0.5, 0.5, 0.5)], a[3:], [("a", 1, 8, 0.5, 0.5, 0.5)], [END]])
    got = {(r.frame_seq, r.point_id): r.keep for r in run(filter_stream(stream, 1.0, 2, 2, buckets=2), spark, "late", tmp_path / "c")}
    assert got == {(0, 0): False, (1, 0): True, (2, 0): True, (3, 0): True}


def test_one_sensor_is_spread_and_its_state_is_bounded(spark, tmp_path):
    rows = some_points("a", range(12), 60)
    stream = dealt_out(spark, tmp_path, [*([r for r in rows if r[1] == f] for f in range(12)), [END]])
    query = filter_stream(stream, 1.0, 3, 2, buckets=16).writeStream.format("memory").queryName("spread").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    keyed = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]]
    # the keyed step holds no more than the window's frames, and the open one, for each bucket
    kept = [next(o for o in ops if "transformWithState" in o["operatorName"])["numRowsTotal"] for ops in keyed]
    assert max(kept) <= 16 * (3 + 2) and kept[-1] <= 16 * 3
    assert spark.table("spread").count() == len(rows)
    from voxelgate.functions.geometry import with_voxels

    placed = with_voxels(spark.createDataFrame(rows, FRAME), 1.0).select(F.pmod(F.xxhash64("vx", "vy", "vz"), F.lit(16)).alias("bucket")).distinct()
    assert placed.count() > 8


def test_ids_beyond_doubles_in_a_batch_that_closes_a_frame(spark, tmp_path):
    rows = [("a", f, (1 << 53) + 1 + 2 * i, 0.5, 0.5, 0.5) for f in range(3) for i in range(4)]
    stream = dealt_out(spark, tmp_path, [*([r for r in rows if r[1] == f] for f in range(3)), [END]])
    got = [(r.sensor, r.frame_seq, r.point_id) for r in run(filter_stream(stream, 1.0, 3, 2, buckets=1), spark, "large_ids", tmp_path / "c")]
    assert sorted(got) == [r[:3] for r in rows]


class HeldState(dict):
    """A map state of this process, with the size of its largest value."""

    largest = 0

    def updateValue(self, key, value):
        self.largest = max(self.largest, *[len(v) for v in value if isinstance(v, bytes)])
        self[key] = value

    getValue, containsKey, removeKey = dict.__getitem__, dict.__contains__, dict.__delitem__


class Held(dict):
    def getMapState(self, name, key, value):
        return self.setdefault(name, HeldState())


def test_a_bucket_is_held_and_closed_in_pieces():
    """Two frames of 300,000 points in one bucket, over two micro-batches; the third has 5 points in the one that closes it."""
    rng = np.random.default_rng(4)
    n = [300_000, 300_000, 5]
    frames = [pd.DataFrame({"sensor": "a", "frame_seq": f, "bucket": 0, "point_id": range(n[f]), **{a: rng.uniform(-9, 9, n[f]) for a in "xyz"}}) for f in range(3)]
    pieces = lambda *parts: temporal.pack(p[at : at + 10_000] for p in parts for at in range(0, len(p), 10_000))
    told = pd.DataFrame({"sensor": "a", "frame_seq": [2, 0, 1], "bucket": 0, "points": None})
    held, worker = Held(), temporal.PersistenceProcessor(0.5, 2, 2)
    worker.init(held)
    for f in (slice(0, 100_000), slice(100_000, None)):
        assert not list(worker.handleInputRows(("a", 0), pieces(frames[1][f], frames[0][f]), None))
    assert len(held["whole"]) == 8 and [k[0] for k in held["open"]] == [1, 0]
    out = list(worker.handleInputRows(("a", 0), iter([told, *pieces(frames[2])]), None))
    assert max(len(o) for o in out) <= 65_536 and max(held[k].largest for k in ("open", "whole")) <= 65_536 * 32
    window = PersistenceWindow(0.5, 2, 2)
    want = [window.push(p[["x", "y", "z"]].to_numpy()) for p in frames]
    for f, keep in enumerate(want):
        got = pd.concat([o for o in out if o["frame_seq"].iloc[0] == f]).sort_values("point_id")
        assert got["point_id"].tolist() == list(range(n[f])) and (got["keep"].to_numpy() == keep).all()
    assert 0 < want[1].sum() < n[1] and not held["open"] and not held["whole"] and sorted(held["seen"]) == [(1,), (2,)]
    # what comes now is too late
    assert not list(worker.handleInputRows(("a", 0), pieces(frames[0]), None)) and not held["open"] and not held["whole"]


def test_window_skips_empty_frames():
    w = PersistenceWindow(1.0, 2, 2)
    a = np.array([[0.5, 0.5, 0.5]])
    assert [w.push(x).tolist() for x in (a, np.zeros((0, 3)), a, a + 5)] == [[False], [], [True], [False]]


def msg(name, stamp, received):
    return Message(json.dumps([name]), stamp, received)


@pytest.mark.parametrize(
    ("messages", "stamp", "now", "want"),
    [
        ([], 1.0, 0.0, (None, True)),
        ([msg("a", None, 0.0)], 1.0, 0.3, (None, True)),
        ([msg("a", None, 0.0)], 1.0, 0.25, ("a", False)),
        ([msg("a", 1.0, 0.0), msg("b", 1.25, 0.0)], 1.125, 9.0, ("a", False)),
        ([msg("a", 1.3, 0.0)], 1.1, 9.0, ("a", False)),
        ([msg("a", 1.25, 0.0)], 1.0, 0.0, (None, True)),
        ([msg("a", 5.0, 0.0), msg("b", None, 0.0)], 1.0, 0.0, (None, True)),
        ([msg("a", 0.1, 0.0), msg("b", None, 0.0)], 9.0, 0.1, ("b", False)),
        ([msg("a", 1.0, 0.0)], None, 99.0, ("a", False)),
        ([msg("a", 1.0, 0.0), msg("b", None, 0.0)], None, 99.0, (None, True)),
        ([msg("a", None, 0.0), msg("b", 1.0, 0.0)], 1.1, 0.1, ("b", False)),
    ],
)
def test_box_rules(messages, stamp, now, want):
    found, stale = BoxBuffer(messages=messages).select(stamp, now)
    assert (json.loads(found.boxes)[0] if found else None, stale) == want


def test_buffer_drops_the_oldest_and_forgets_what_is_old():
    b = BoxBuffer(history=2)
    for i in range(3):
        b.add(msg(str(i), float(i), 0.0))
    assert [json.loads(m.boxes)[0] for m in b.messages] == ["1", "2"]
    b.select(2.0, 0.0)
    assert len(b.messages) == 1 and b.select(1.0, 0.0) == (None, True)


def test_box_stream(spark, tmp_path):
    good = '{"objects":[{"bbox":{"center":{"x":1,"y":2,"z":3},"size":[4,2,1]},"heading":0.5,"class_name":"car"},{"size":[1,1,1]},{"center":[0,0,0],"size":[0.001,1,1]}],"stamp":{"sec":10,"nanosec":500000000}}'
    raw = [("s", 1.0, None, good), ("s", 1.1, 20.0, "no json"), ("t", 1.0, 30.0, "[]")]
    clouds = [("s", 7, 2.0, 10.6), ("s", 8, 2.1, 11.0), ("t", 9, 2.0, 30.1)]
    spark.createDataFrame(raw, "sensor string, arrival double, msg_stamp double, payload string").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(clouds, "sensor string, cloud_id long, arrival double, stamp double").write.parquet(str(tmp_path / "k"))
    read = lambda p: spark.readStream.schema(spark.read.parquet(str(p)).schema).parquet(str(p))
    rows = run(select_boxes(read(tmp_path / "k"), read_messages(read(tmp_path / "m"))), spark, "chosen", tmp_path / "c")
    assert {r.cloud_id: (r.has_boxes, r.stale) for r in rows} == {7: (True, False), 8: (False, True), 9: (False, False)}
    (b,) = parsed_boxes(spark.createDataFrame(rows)).collect()
    assert (b.cloud_id, b.cx, b.l, b.yaw, b.label) == (7, 1, 4, 0.5, "car")


CASES = [
    ('{"center":[1,2,3],"size":[1,1,1],"yaw":true}', "core", None),
    ('{"center":null,"x":1,"y":2,"z":3,"size":[1,1,1]}', "core", None),
    ('{"x":1,"y":2,"z":3,"size":[0,1,1],"l":2,"w":2,"h":2}', "core", (1, 2, 0)),
    ('{"x":1,"y":2,"z":3,"size":[1,1],"l":2,"w":2,"h":2}', "core", None),
    ('{"pose":{"position":[1,2,3]},"shape":{"x":5,"y":1,"z":1},"rotation":{"yaw":0.25}}', "core", (1, 5, 0.25)),
    ('{"center":[1,2,3],"size":[2,1,1],"rotation":[0,0,0.75]}', "core", (1, 2, 0.75)),
    ('{"center":[1,2,3],"size":[2,1,1],"orientation":[0,0,1,0]}', "core", (1, 2, 3.141592653589793)),
    ('{"center":[1,2,3],"size":[2,1,1],"rpy":[0,0,"0.5"]}', "core", (1, 2, 0.5)),
    ('{"center":{"position":{"x":1,"y":2,"z":3}},"size":[2,1,1]}', "message", None),
    ('{"position":{"x":1,"y":2,"z":3},"scale":[2,1,1],"heading_deg":180}', "message", (1, 2, 3.141592653589793)),
    ('{"box":{"pose":{"position":[1,2,3],"orientation":{"x":0,"y":0,"z":1,"w":0}},"lwh":[2,1,1]}}', "message", (1, 2, 3.141592653589793)),
    ('{"x":1,"y":2,"z":3,"size":"bad","length":2,"width":1,"height":1}', "message", None),
    ('{"x":1,"y":2,"z":3,"length":2,"width":1,"height":1,"type":"bus"}', "message", (1, 2, 0)),
]


@pytest.mark.parametrize(("text", "name", "want"), CASES)
def test_entries(spark, text, name, want):
    rows = parse_boxes(spark.createDataFrame([(text,)], "p string"), "p", name).collect()
    assert [(r.cx, r.l, pytest.approx(r.yaw)) for r in rows] == ([want] if want else [])


@pytest.mark.parametrize(("text", "n"), [('{"detections":[{"center":[1,2,3],"size":[1,1,1]}]}', 1), ('{"objects":{"a":1},"boxes":[]}', 0), ('[{"center":[1,2,3],"size":[1,1,1]},7]', 1), ("7", 0), ("nope", 0)])
def test_payloads(spark, text, n):
    assert parse_boxes(spark.createDataFrame([(text,)], "p string"), "p").count() == n


@pytest.mark.parametrize(("text", "want"), [('{"stamp":5}', 5.0), ('{"header":{"stamp":{"secs":1,"nsecs":500000000}}}', 1.5), ('{"time":{"sec":3}}', 3.0), ('{"stamp":0}', None), ('"{\\"stamp\\":4}"', 4.0), ("{}", None)])
def test_stamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "p string").select(message_stamp(document(F.col("p")))).first()[0] == want


def test_box_run_from_end_to_end(spark, tmp_path):
    """Clouds 1 and 2 have boxes in time, 3 has a message without boxes, 4 is stale, 5 has no points."""
    at = {1: 1.0, 2: 2.0, 3: 3.0, 4: 9.0, 5: 2.1}
    rows = [(str(k), i, float(i), 0.0, 0.0) for k in at if k != 5 for i in range(10)]
    sent = pointcloud2.encode(spark.createDataFrame(rows, "frame_id string, point_id long, x double, y double, z double"), spark.createDataFrame([(str(k),) for k in at], "frame_id string"))
    stamps = spark.createDataFrame([(str(k), "s", k, t + 0.5, t) for k, t in at.items()], "frame_id string, sensor string, cloud_id long, arrival double, stamp double")
    sent.join(stamps, "frame_id").drop("frame_id").write.parquet(str(tmp_path / "k"))
    box = lambda x: json.dumps({"objects": [{"center": [x, 0, 0], "size": [2.1, 1, 1], "name": "car"}]})
    told = [("s", 1.2, 1.1, box(0)), ("s", 2.2, 1.9, box(5)), ("s", 3.2, 3.0, "[]"), ("s", 3.3, 3.0, "no json")]
    spark.createDataFrame(told, "sensor string, arrival double, msg_stamp double, payload string").write.parquet(str(tmp_path / "m"))
    read = lambda p: spark.readStream.schema(spark.read.parquet(str(p)).schema).parquet(str(p))
    reports = []
    figures = pipeline.RunFigures(reports.append, period=2)
    pipeline.run_boxes(read(tmp_path / "k"), read(tmp_path / "m"), pipeline.publish(str(tmp_path / "out")), str(tmp_path / "c"), figures, once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    kept = pointcloud2.decode(out).groupBy("frame_id").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    every = [float(i) for i in range(10)]
    assert {r.frame_id: r.x for r in kept} == {"1": every[2:], "2": [x for x in every if x not in (4, 5, 6)], "3": every, "4": every}
    assert {r.frame_id: r.width for r in out.collect()} == {"1": 8, "2": 7, "3": 10, "4": 10, "5": 0}
    figures.write(spark, str(tmp_path / "s.json"))
    s = json.loads((tmp_path / "s.json").read_text())
    want = {"frames": 5, "input_points": 40, "output_points": 35, "removed_points": 5, "removed_ratio": 0.125, "boxes_received": 3, "frames_with_boxes": 2, "frames_without_boxes": 3, "stale_box_frames": 3}
    assert {k: s[k] for k in want} == want and s["mean_ms"] > 0 and reports


def test_persistence_run_keeps_its_figures(spark, tmp_path):
    """What is all kept counts as nothing removed."""
    rows = [("a", f, i, float(i), 0.0, 0.0) for f in range(4) for i in range(10)]
    spark.createDataFrame([*rows, END], FRAME).write.parquet(str(tmp_path / "in"))
    figures = pipeline.RunFigures()
    stream = spark.readStream.schema(FRAME).parquet(str(tmp_path / "in"))
    pipeline.run_persistence(stream, pipeline.publish(str(tmp_path / "out")), str(tmp_path / "c"), figures, 1.0, 3, 1, once=True, buckets=3).awaitTermination()
    s = figures.summary(spark)
    assert (s["frames"], s["input_points"], s["output_points"], s["removed_ratio"]) == (4, 40, 40, 0.0) and spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert pipeline.RunFigures().summary(spark)["removed_ratio"] == 0.0


class Stopped(Exception):
    pass


def test_a_run_that_fails_after_publishing_publishes_once(spark, tmp_path):
    """The sink is done when the run ends, so its micro-batch comes again; results and figures are those of one run."""
    rows = some_points("a", range(6), 10)
    stream = lambda: spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    dealt_out(spark, tmp_path, [*([r for r in rows if r[1] == f] for f in range(6)), [END]])
    for kind in ("folder", "topic"):
        out, state = str(tmp_path / f"out-{kind}"), str(tmp_path / f"c-{kind}")
        publish = pipeline.publish(out) if kind == "folder" else pipeline.publish_topic(out, state)
        failed = []

        def once_failing(df, number, publish=publish, failed=failed):
            publish(df, number)
            if number == 3 and not failed:
                failed.append(number)
                raise Stopped

        for _ in range(2):
            figures = pipeline.RunFigures(folder=f"{state}-figures")
            query = pipeline.run_persistence(stream(), once_failing, state, figures, 1.0, 3, 1, once=True, buckets=2)
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001  the query's own error wraps it
                assert failed
        found = spark.read.parquet(out) if kind == "folder" else topics.read_topic(spark, out, FRAME)
        assert sorted((r.frame_seq, r.point_id) for r in found.collect()) == sorted((r[1], r[2]) for r in rows)
        s = pipeline.RunFigures(folder=f"{state}-figures").summary(spark)
        assert failed and (s["frames"], s["input_points"], s["output_points"]) == (6, 60, 60)


def test_figures_after_a_crash_before_they_are_committed(tmp_path):
    """A micro-batch that is added again replaces what it added before."""
    one = {"frames": 2, "input_points": 10, "output_points": 4}
    for number in (0, 1, 1, 2, 2, 3):
        figures = pipeline.RunFigures(folder=str(tmp_path / "f"))
        figures.add(one, [1.0, 2.0], number)
    assert figures.totals["frames"] == 8 and len(figures.times) == 8 and len(list((tmp_path / "f").iterdir())) == 2


def test_times_are_those_of_frames(spark, tmp_path):
    """A live run's times run from each frame's arrival."""
    import time

    now = time.time()
    sent = pointcloud2.encode(spark.createDataFrame([("1", 0, 0.0, 0.0, 0.0), ("2", 0, 0.0, 0.0, 0.0)], "frame_id string, point_id long, x double, y double, z double"))
    sent.selectExpr("*", "'s' AS sensor", "CAST(frame_id AS BIGINT) AS cloud_id", f"{now} - 100 * CAST(frame_id AS INT) AS arrival", "CAST(1 AS DOUBLE) AS stamp").drop("frame_id").write.parquet(str(tmp_path / "k"))
    spark.createDataFrame([("s", 0.0, 1.0, "[]")], "sensor string, arrival double, msg_stamp double, payload string").write.parquet(str(tmp_path / "m"))
    read = lambda p: spark.readStream.schema(spark.read.parquet(str(p)).schema).parquet(str(p))
    figures = pipeline.RunFigures()
    pipeline.run_boxes(read(tmp_path / "k"), read(tmp_path / "m"), pipeline.publish(str(tmp_path / "out")), str(tmp_path / "c"), figures, once=True, live=True).awaitTermination()
    first, second = figures.times
    assert 200_000 <= first < 300_000 and 100_000 <= second < 200_000


NUMBERS = "sensor string, n long"


def numbers(spark, topic, ns, **how):
    topics.append_topic(spark.createDataFrame([("s", n) for n in ns], NUMBERS).repartition(2), str(topic), **how)


def test_topic_takes_a_batch_once(spark, tmp_path):
    numbers(spark, tmp_path / "t", [1, 2], entry=0, producer="p")
    numbers(spark, tmp_path / "t", [3], entry=1, producer="p")
    numbers(spark, tmp_path / "t", [3], entry=1, producer="p")
    numbers(spark, tmp_path / "t", [4])
    assert sorted(r.n for r in topics.read_topic(spark, str(tmp_path / "t"), NUMBERS).collect()) == [1, 2, 3, 4]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4
    with pytest.raises(Exception, match="another query"):
        numbers(spark, tmp_path / "t", [5], entry=0, producer="q")
    assert topics.read_topic(spark, str(tmp_path / "none"), NUMBERS).count() == 0


def test_topic_writer_between_write_and_commit(tmp_path):
    """Files of a task that was never committed, and of one that was lost, are not part of the topic."""
    import pyarrow as pa

    batch = pa.record_batch({"sensor": ["s"], "n": [1]})
    options = {"path": str(tmp_path / "t"), "checkpointLocation": "c"}
    topics.TopicStreamWriter(options).write(iter([batch]))
    again = topics.TopicStreamWriter(options)
    message = again.write(iter([batch]))
    again.commit([message, None], 0)
    again.commit([again.write(iter([batch]))], 0)
    assert topics.Log(str(tmp_path / "t")).paths(0, 1) == [f"{tmp_path}/t/data/{message.name}"]


def test_topic_to_topic_with_bounded_batches_and_a_restart(spark, tmp_path):
    """Five entries, two a micro-batch; the run's last commit is lost, so that its last micro-batch comes again, and more come after."""
    source, state, out = str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "out")
    for n in range(5):
        numbers(spark, source, [2 * n, 2 * n + 1])

    def go():
        spark.dataSource.register(topics.TopicSource)
        rows = topics.stream_topic(spark, source, NUMBERS, checkpoint=state, max_entries=2)
        query = rows.writeStream.format(topics.FORMAT).option("path", out).option("checkpointLocation", state).start()
        query.processAllAvailable()
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        return sizes

    assert go() == [4, 4, 2]
    commits = sorted((p for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    numbers(spark, source, [10, 11])
    assert go() == [2, 2]
    assert sorted(r.n for r in topics.read_topic(spark, out, NUMBERS).collect()) == list(range(12))
    assert go() == []


POINTS = "frame_id string, point_id long, x double, y double, z double"


def test_clouds_of_one_sensor_are_spread(spark, tmp_path):
    """No task has all clouds of a sensor, only what tells them."""
    sent = pointcloud2.encode(spark.createDataFrame([(str(k), i, float(i), 0.0, 0.0) for k in range(24) for i in range(3)], POINTS))
    sent.selectExpr("'s' AS sensor", "CAST(frame_id AS BIGINT) AS cloud_id", "CAST(frame_id AS DOUBLE) AS arrival", "CAST(frame_id AS DOUBLE) AS stamp", f"struct({', '.join(pointcloud2.FIELDS)}) AS cloud").write.parquet(str(tmp_path / "k"))
    spark.createDataFrame([("s", 1.0, 1.0, "[]")], "sensor string, arrival double, msg_stamp double, payload string").write.parquet(str(tmp_path / "m"))
    read = lambda p: spark.readStream.schema(spark.read.parquet(str(p)).schema).parquet(str(p))
    chosen = select_boxes(read(tmp_path / "k"), read_messages(read(tmp_path / "m")), carry=True)
    found = []
    chosen.writeStream.foreachBatch(lambda b, _: found.extend(b.filter("cloud IS NOT NULL").select("cloud_id", "cloud.width", F.spark_partition_id().alias("task")).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.cloud_id, r.width) for r in found) == [(k, 3) for k in range(24)]
    assert len({r.task for r in found}) > 1


def test_a_cloud_is_cut_into_parts(spark):
    """In the order of its points, with a head, and joined again; a frame without points has a head only."""
    n = 2 * pointcloud2.PART + 5
    points = spark.range(n).selectExpr("'a' AS frame_id", "id AS point_id", "CAST(id AS DOUBLE) AS x", "0.0D AS y", "1.0D AS z").unionByName(spark.createDataFrame([("b", 3, 7.0, 0.0, 0.0)], POINTS))
    parts = pointcloud2.encode_parts(points, spark.createDataFrame([("a",), ("b",), ("c",)], "frame_id string"))
    found = sorted((r.frame_id, r.part, r.width, len(r.data)) for r in parts.select("frame_id", "part", "width", "data").collect())
    assert [f[0] for f in found if f[1] == 0] == ["a", "b", "c"] and all(f[2] == 0 for f in found if f[1] == 0)
    assert max(f[2] for f in found) <= pointcloud2.PART and all(f[3] == 12 * f[2] for f in found)
    assert {k: sum(f[2] for f in found if f[0] == k) for k in "abc"} == {"a": n, "b": 1, "c": 0}
    whole = {r.frame_id: r for r in pointcloud2.join_parts(parts).collect()}
    assert {k: r.width for k, r in whole.items()} == {"a": n, "b": 1, "c": 0}
    assert (np.frombuffer(whole["a"].data, "<f4").reshape(-1, 3)[:, 0] == np.arange(n)).all()


def test_box_run_in_parts_over_two_batches(spark, tmp_path):
    """Clouds and messages come in parts; cloud 2 comes a micro-batch after its message, whose boxes are in the state."""
    def clouds(*names, bare):
        rows = [(str(k), 1 + i % 3, i, float(i), 0.0, 0.0) for k in names for i in range(10)]
        sent = pointcloud2.encode_parts(spark.createDataFrame(rows, "frame_id string, part long, point_id long, x double, y double, z double"), spark.createDataFrame([(str(k),) for k in (*names, bare)], "frame_id string"))
        return sent.selectExpr("'s' AS sensor", "CAST(frame_id AS BIGINT) AS cloud_id", "CAST(frame_id AS DOUBLE) + 0.5 AS arrival", "CAST(frame_id AS DOUBLE) AS stamp", "* EXCEPT (frame_id)")

    box = lambda x: json.dumps({"objects": [{"center": [x, 0, 0], "size": [1, 1, 1]}]})
    kind = "sensor string, message_id long, part long, arrival double, msg_stamp double, payload string"
    told = [("s", n, p, n + 0.2, float(n), "[]" if p == 0 else box(2 * n + 3 * p)) for n in (1, 2) for p in range(3)]
    figures = pipeline.RunFigures()

    def go(sent, messages):
        topics.append_topic(sent, str(tmp_path / "k"))
        if messages:
            topics.append_topic(spark.createDataFrame(messages, kind), str(tmp_path / "m"))
        streams = [topics.stream_topic(spark, str(tmp_path / t), s) for t, s in (("k", sent.schema), ("m", kind))]
        pipeline.run_boxes(*streams, pipeline.publish_topic(str(tmp_path / "out"), "p"), str(tmp_path / "c"), figures, once=True).awaitTermination()

    go(clouds(1, bare=0), told)
    go(clouds(2, 3, bare=4), [])
    out = topics.read_topic(spark, str(tmp_path / "out"), f"part long, {pointcloud2.MESSAGE}")
    kept = {r.frame_id: r.x for r in pointcloud2.decode(out).groupBy("frame_id").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()}
    every = [float(i) for i in range(10)]
    assert kept == {"1": [x for x in every if x not in (5, 8)], "2": [x for x in every if x != 7], "3": every}
    assert sorted(r.frame_id for r in out.filter("part = 0").collect()) == ["0", "1", "2", "3", "4"]
    s = figures.summary(spark)
    want = {"frames": 5, "input_points": 30, "output_points": 27, "boxes_received": 2, "frames_with_boxes": 2}
    assert {k: s[k] for k in want} == want
    with pytest.raises(Exception, match="without its head"):
        go(clouds(5, bare=6).filter("part > 0"), [])
