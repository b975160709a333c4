"""Boxes for the clouds of a stream: the buffered message that is nearest in time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.payload import document, entries, message_stamp, read_entry

STALE_TIME, HISTORY = 0.25, 64
#: Keys of a sensor's packed clouds, which go past its messages.
LANES = 1024
#: Characters of boxes that are put into one table.
_TEXT = 1 << 22
OUTPUT = "sensor string, cloud_id long, boxes string, has_boxes boolean, stale boolean"
_BOX = "array<struct<cx:double,cy:double,cz:double,l:double,w:double,h:double,yaw:double,label:string>>"


@dataclass
class Message:
    boxes: str
    stamp: float | None
    received: float
    number: int = 0
    parts: tuple[int, ...] = ()

    @property
    def filled(self) -> bool:
        return self.boxes != "[]" or bool(self.parts)


class BoxBuffer:
    """The latest messages, oldest first; the oldest go when there are too many."""

    def __init__(self, stale_time: float = STALE_TIME, history: int = HISTORY, messages: list[Message] | None = None):
        self.stale_time, self.history, self.messages = stale_time, history, list(messages or [])

    def add(self, message: Message) -> None:
        self.messages = [*self.messages, message][-self.history :]

    def _drop_head(self, old) -> None:
        while self.messages and old(self.messages[0]):
            self.messages.pop(0)

    def select(self, stamp: float | None, now: float) -> tuple[Message | None, bool]:
        """The message for a cloud, and whether there is none that is fresh enough.

        Old heads go first. A stamped cloud takes the stamped message nearest to it, strictly
        within the stale time, the earliest of equals, later stamps too; only where no message has
        a stamp it takes the newest one received in time. A cloud without a stamp takes the
        newest, which only has to be fresh if it has no stamp either.
        """
        self._drop_head(lambda m: m.stamp is None and now - m.received > self.stale_time)
        if stamp is not None:
            self._drop_head(lambda m: m.stamp is not None and stamp - m.stamp > self.stale_time)
        if not self.messages:
            return None, True
        newest = self.messages[-1]
        fresh = now - newest.received <= self.stale_time
        if stamp is None:
            return (newest, False) if newest.stamp is not None or fresh else (None, True)
        stamped = [m for m in self.messages if m.stamp is not None]
        if stamped:
            best = min(stamped, key=lambda m: abs(stamp - m.stamp))
            return (best, False) if abs(stamp - best.stamp) < self.stale_time else (None, True)
        return (newest, False) if fresh else (None, True)


class BoxProcessor(StatefulProcessor):
    """The messages of a sensor and what tells its clouds; with carry, packed clouds have keys of their own and go out as they come.

    A message in parts has its boxes in the state, part by part, and gives them out so.
    """

    def __init__(self, stale_time: float, history: int, carry: bool, parted: bool):
        self.stale_time, self.history, self.carry, self.parted = stale_time, history, carry, parted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("messages", "boxes string, stamp double, received double, number long")
        self.parts = handle.getMapState("parts", "number long, part long", "boxes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.carry and key[1]:
            for part in rows:
                yield pd.DataFrame({"sensor": key[0], "cloud_id": part["number"], "boxes": "[]", "has_boxes": False, "stale": True, "piece": 0, "arrival": part["arrival"], "cloud": part["cloud"]})
            return
        value = lambda x: None if pd.isna(x) else float(x)
        heads = pd.concat([self._hold(part) for part in rows] if self.parted else list(rows))
        parts: dict[int, tuple[int, ...]] = {}
        for number, part in sorted(tuple(k) for k in self.parts.keys()) if self.parted else ():
            parts[number] = (*parts.get(number, ()), part)
        buffer = BoxBuffer(self.stale_time, self.history, [Message(r[0], value(r[1]) if r[1] is not None else None, r[2], r[3], parts.get(r[3], ())) for r in self.kept.get()])
        known = {m.number for m in buffer.messages} | set(heads.loc[~heads["is_cloud"], "number"].tolist())
        if parts.keys() - known:
            raise ValueError(f"parts of the message {min(parts.keys() - known)} came without its head")
        out, size = [], 0
        for r in heads.sort_values(["arrival", "is_cloud"], kind="stable").itertuples():
            if not r.is_cloud:
                buffer.add(Message(r.boxes, value(r.stamp), r.arrival, r.number, parts.get(r.number, ())))
                if self.carry:
                    out.append((key[0], None, "[]", False, False, 0, r.arrival, None))
                continue
            found, stale = buffer.select(value(r.stamp), r.arrival)
            for piece, boxes in enumerate(self._boxes(found)):
                out.append((key[0], r.number, boxes, bool(found and found.filled), stale, *([piece, r.arrival, None] if self.carry else [])))
                size += len(boxes)
                if size >= _TEXT:
                    yield self._table(out)
                    out, size = [], 0
        if buffer.messages:
            self.kept.put([(m.boxes, m.stamp, m.received, m.number) for m in buffer.messages])
        else:
            self.kept.clear()
        for number in parts.keys() - {m.number for m in buffer.messages}:
            for part in parts[number]:
                self.parts.removeKey((number, part))
        yield self._table(out)

    def _hold(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Puts the parts of messages into the state; the other rows."""
        more = ~rows["is_cloud"] & (rows["part"] > 0)
        for number, part, boxes in rows.loc[more, ["number", "part", "boxes"]].itertuples(index=False):
            # the message has no boxes in this part
            if boxes != "[]":
                self.parts.updateValue((number, part), (boxes,))
        return rows[~more].drop(columns="cloud", errors="ignore")

    def _boxes(self, found: Message | None) -> Iterator[str]:
        """The boxes of a message, part by part."""
        if found is None or found.boxes != "[]" or not found.parts:
            yield found.boxes if found else "[]"
        for part in found.parts if found else ():
            yield self.parts.getValue((found.number, part))[0]

    def _table(self, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["sensor", "cloud_id", "boxes", "has_boxes", "stale", *(["piece", "arrival", "cloud"] if self.carry else [])])
        return made.astype({"cloud_id": "Int64"})

    def close(self) -> None:
        pass


def read_messages(raw: DataFrame, min_size: float = 0.01) -> DataFrame:
    """Object messages (sensor, arrival, msg_stamp, payload JSON) to sensor, arrival, stamp and boxes (JSON).

    The payload's own stamp goes before the message's. Boxes smaller than min_size on a side, and
    entries that can't be read, are left out; a message without boxes still counts, one that is no
    JSON doesn't. message_id and part go through, if they are there.
    """
    v = document(F.col("payload"))
    sound = raw.withColumn("_ok", v.isNotNull()).filter("_ok").withColumn("stamp", F.coalesce(message_stamp(v), F.col("msg_stamp")))
    parsed = boxes_column(sound)
    return parsed.select("sensor", "arrival", "stamp", *[c for c in ("message_id", "part") if c in raw.columns], F.to_json(F.filter("_boxes", lambda b: (b["l"] >= min_size) & (b["w"] >= min_size) & (b["h"] >= min_size))).alias("boxes"))


def boxes_column(rows: DataFrame) -> DataFrame:
    """rows with payload to rows with _boxes, an array; row by row, so it works on streams."""

    listed = F.transform(entries(document(F.col("payload")), "message"), lambda e: read_entry(e, "message"))
    fields = ("cx", "cy", "cz", "l", "w", "h", "yaw", "label")
    return rows.withColumn("_boxes", F.transform(F.filter(listed, lambda x: x["ok"]), lambda x: F.struct(*[x[c].alias(c) for c in fields])))


def select_boxes(clouds: DataFrame, messages: DataFrame, stale_time: float = STALE_TIME, history: int = HISTORY, carry: bool = False) -> DataFrame:
    """Streams of clouds (sensor, cloud_id, arrival, stamp) and of messages as of read_messages: the boxes of each cloud.

    Arrival (seconds of the receiving clock) orders both streams within a micro-batch. State is at
    most history messages for each sensor. Messages with message_id (the sensor's own) and part
    come in parts: part 0 is the head, whose times count, and all of them come in one micro-batch;
    the clouds that take such a message have a row for each of its parts that has boxes.

    carry: clouds have a column cloud (struct) and may come in parts, of which part 0 tells the cloud. The
    result has rows with a cloud, which are the parts as they came, spread over all tasks, and
    those without: one for each cloud (piece 0; pieces of more have further boxes), and one with a
    null cloud_id for each message. Needs the RocksDB state store.
    """
    zero, parted = F.lit(0).cast("long"), "message_id" in messages.columns
    common = ["sensor", "arrival", "stamp", "number", "part", "boxes", "is_cloud"]
    part = F.coalesce(F.col("part"), zero).cast("long") if "part" in clouds.columns else zero
    heads = clouds.withColumns({"number": F.col("cloud_id").cast("long"), "part": part, "boxes": F.lit("[]"), "is_cloud": F.lit(True)})
    told = messages.withColumns({"number": F.col("message_id").cast("long") if parted else zero, "part": F.coalesce(F.col("part"), zero).cast("long") if parted else zero, "is_cloud": F.lit(False)}).select(*common)
    processor = BoxProcessor(stale_time, history, carry, parted)
    if not carry:
        return heads.filter("part = 0").select(*common).unionByName(told).groupBy("sensor").transformWithStateInPandas(processor, OUTPUT, "append", "none")
    kind = clouds.schema["cloud"].dataType
    lane = F.lit(1) + F.pmod(F.xxhash64("number", "part"), F.lit(LANES)).cast("int")
    ways = F.array(F.when(F.col("part") == 0, F.struct(F.lit(0).alias("lane"), F.lit(None).cast(kind).alias("cloud"))), F.when(F.col("cloud.width") > 0, F.struct(lane.alias("lane"), "cloud")))
    sent = heads.select(*common, F.explode(F.array_compact(ways)).alias("way")).select(*common, "way.lane", "way.cloud")
    both = sent.unionByName(told.withColumns({"lane": F.lit(0), "cloud": F.lit(None).cast(kind)}))
    return both.groupBy("sensor", "lane").transformWithStateInPandas(processor, f"{OUTPUT}, piece int, arrival double, cloud {kind.simpleString()}", "append", "none")


def parsed_boxes(selected: DataFrame) -> DataFrame:
    """Boxes of select_boxes as rows."""
    return selected.withColumn("b", F.explode(F.from_json("boxes", _BOX))).select("sensor", "cloud_id", "b.*")
