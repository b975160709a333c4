"""Topics: folders of packed clouds or messages that streams append to and read from, each batch exactly once.

A topic has data files and a log with one entry for each batch, which names the batch's files. A
batch is there once its entry is, and the entry has the batch's number: a batch that is written
again after a failure finds its entry and leaves it as it is. Readers count entries, take a
bounded number of them at a time, and find their place in the query's checkpoint after a restart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files
from .pointcloud2 import MESSAGE

FORMAT = "cloud_topic"
#: A packed cloud with its sensor, number and times.
CLOUD = f"sensor string, cloud_id long, arrival double, stamp double, {MESSAGE.partition(', ')[2]}"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Written(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class Log:
    """The entries of a topic; numbers have no gaps as its one writer counts them up."""

    def __init__(self, topic: str):
        self.topic = topic.rstrip("/")

    def _path(self, number: int) -> str:
        return f"{self.topic}/log/{number:012d}.json"

    def end(self) -> int:
        found = [int(n.removesuffix(".json")) for n in files.names(f"{self.topic}/log") if n.endswith(".json")]
        return max(found, default=-1) + 1

    def read(self, number: int) -> dict:
        return json.loads(files.read_bytes(self._path(number)))

    def paths(self, first: int, end: int) -> list[str]:
        return [f"{self.topic}/data/{name}" for n in range(first, end) for name, _ in self.read(n)["files"]]

    def append(self, number: int, producer: str, written: list[_Written]) -> bool:
        """Whether the entry is new. One of the same producer is left as it is; of another it is an error."""
        if files.exists(self._path(number)):
            if self.read(number)["producer"] != producer:
                raise ValueError(f"entry {number} of {self.topic} was written by another query")
            return False
        files.write_whole(self._path(number), json.dumps({"producer": producer, "files": [(w.name, w.rows) for w in written]}).encode())
        return True


class _Writer:
    def __init__(self, options: dict):
        self.log, self.producer = Log(options["path"]), options.get("checkpointLocation") or options.get("producer") or ""

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, rows, sink = f"{uuid.uuid4().hex}.arrow", 0, None
        system, inner, _ = files.located(f"{self.log.topic}/data/{name}")
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                stream = system.open_output_stream(inner)
                sink = pa.ipc.new_file(stream, batch.schema)
            sink.write_batch(batch)
            rows += batch.num_rows
        if sink is not None:
            sink.close()
            stream.close()
        return _Written(name, rows)

    def _drop(self, messages) -> None:
        for m in messages:
            if m is not None and m.rows:
                files.delete(f"{self.log.topic}/data/{m.name}")

    def _commit(self, messages, number: int) -> None:
        written = [m for m in messages if m is not None and m.rows]
        if not self.log.append(number, self.producer, written):
            self._drop(written)


class TopicStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


class TopicWriter(_Writer, DataSourceArrowWriter):
    """One entry: the option entry, as of a micro-batch, or the next."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.number = options.get("entry")

    def commit(self, messages) -> None:
        self._commit(messages, self.log.end() if self.number is None else int(self.number))

    def abort(self, messages) -> None:
        self._drop(messages)


def _rows(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    with files.open_input(path) as f:
        known = pa.ipc.open_file(f).schema.names
        file = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[known.index(c) for c in columns]))
        for i in range(file.num_record_batches):
            yield file.get_batch(i).select(columns)


class TopicReader(DataSourceReader):
    """All entries that are there."""

    def __init__(self, options: dict, schema: StructType):
        self.log, self.columns = Log(options["path"]), schema.fieldNames()

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.log.paths(0, self.log.end())]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        return _rows(partition.path, self.columns) if partition is not None else iter(())


class TopicStreamReader(DataSourceStreamReader):
    """Offsets are numbers of entries. Options: maxEntries (0: all that are there) and checkpoint, which a bounded reader needs to find its place."""

    def __init__(self, options: dict, schema: StructType):
        self.log, self.columns = Log(options["path"]), schema.fieldNames()
        self.most, self.checkpoint = int(options.get("maxEntries", 0)), options.get("checkpoint")
        if self.most and not self.checkpoint:
            raise ValueError("maxEntries needs the option checkpoint, the query's checkpoint location")
        self.at: int | None = None

    def _offset(self, number: int) -> dict:
        return {"topic": self.log.topic, "next": number}

    def _planned(self) -> int:
        """The end of the last batch that the checkpoint knows."""
        folder = f"{(self.checkpoint or '').rstrip('/')}/offsets"
        numbers = [int(n) for n in files.names(folder) if n.isdigit()] if self.checkpoint else []
        for line in files.read_bytes(f"{folder}/{max(numbers)}").decode().splitlines() if numbers else []:
            if line.startswith("{") and (offset := json.loads(line)).get("topic") == self.log.topic:
                return int(offset["next"])
        return 0

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._planned()
        there = self.log.end()
        self.at = min(there, self.at + self.most) if self.most else there
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[_File]:
        self.at = max(self.at or 0, int(end["next"]))
        return [_File(p) for p in self.log.paths(int(start["next"]), int(end["next"]))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(partition.path, self.columns)

    def commit(self, end: dict) -> None:
        pass


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CLOUD

    def reader(self, schema: StructType) -> DataSourceReader:
        return TopicReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TopicStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return TopicWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(self.options)


def read_topic(spark, path: str, schema: str = CLOUD) -> DataFrame:
    spark.dataSource.register(TopicSource)
    return spark.read.format(FORMAT).schema(schema).load(path)


def stream_topic(spark, path: str, schema: str = CLOUD, checkpoint: str | None = None, max_entries: int = 0) -> DataFrame:
    """The topic as a stream; max_entries bounds what a micro-batch takes, and then checkpoint is that of the query."""
    spark.dataSource.register(TopicSource)
    reader = spark.readStream.format(FORMAT).schema(schema).option("maxEntries", max_entries)
    return (reader.option("checkpoint", checkpoint) if checkpoint else reader).load(path)


def append_topic(rows: DataFrame, path: str, entry: int | None = None, producer: str = "") -> None:
    """Appends rows as one entry. With its number, an entry that the producer has written before stays as it is."""
    rows.sparkSession.dataSource.register(TopicSource)
    writer = rows.write.format(FORMAT).option("producer", producer).mode("append")
    (writer if entry is None else writer.option("entry", entry)).save(path)
