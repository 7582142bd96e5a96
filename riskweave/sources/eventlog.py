"""Append-only event log in a shared folder as a Spark data source.

The rows have a message's shape (key, value), so the same JSON payloads pass
through this log, a file stream or a message bus.  Every producer owns a part
of the log::

    <path>/<producer>/data/<commit>-<uuid>.parquet    segments, written by tasks
    <path>/<producer>/commits/<commit>.json           names of a commit's segments, written once

A reader's offset is the number of commits it has seen of each producer; Spark
keeps it in the query's checkpoint, so any number of readers go on where they
were.  A producer's streaming commit bears the micro-batch's number: a batch that
is run again finds its commit and removes its own segments, so rows are there
once.  Segments without a commit (lost tasks, aborted jobs) are never read.

One query writes as one producer.  ``startingOffsets`` (earliest or latest)
counts for a reader's first start alone.  A null key or value stays null; an
empty batch commits no segment; a folder that does not exist yet is an empty log.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

from .tables import EVENT_SCHEMA

FORMAT = "event_log"
SCHEMA = "key string, value string, producer string, commit bigint, pos bigint"
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string())])
ROWS = pa.schema([("key", pa.string()), ("value", pa.string()), ("producer", pa.string()),
                  ("commit", pa.int64()), ("pos", pa.int64())])


@dataclass
class Segment(InputPartition):
    producer: str
    commit: int
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Log:
    """The files of one log, on any file system that Arrow knows by its URI."""

    def __init__(self, path: str):
        self.path = path

    def at(self, *parts: str):
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, "/".join([root.rstrip("/"), *parts])

    def names(self, *parts: str, kind=pafs.FileType.File) -> list[str]:
        fs, folder = self.at(*parts)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == kind)

    def commits(self, producer: str) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names(producer, "commits") if n.endswith(".json")]

    def ends(self) -> dict[str, int]:
        """One more than the last commit of every producer that has one."""
        last = {p: self.commits(p) for p in self.names(kind=pafs.FileType.Directory)}
        return {p: c[-1] + 1 for p, c in last.items() if c}

    def between(self, start: dict, end: dict) -> list[Segment]:
        out = []
        for producer, stop in sorted(end.items()):
            for n in self.commits(producer):
                if start.get(producer, 0) <= n < stop:
                    fs, path = self.at(producer, "commits", f"{n:020d}.json")
                    with fs.open_input_file(path) as f:
                        out += [Segment(producer, n, name) for name in json.loads(f.read())]
        return out

    def rows(self, s: Segment):
        """Arrow batches of a segment, one in memory at a time."""
        fs, path = self.at(s.producer, "data", s.name)
        pos = 0
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches():
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("value"), pa.repeat(pa.scalar(s.producer), n),
                     pa.repeat(pa.scalar(s.commit, pa.int64()), n), pa.array(range(pos, pos + n), pa.int64())], schema=ROWS)
                pos += n

    def write(self, producer: str, batches) -> Written:
        name, sink = None, None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if sink is None:
                    name = f"{uuid.uuid4().hex}.parquet"
                    fs, folder = self.at(producer, "data")
                    fs.create_dir(folder)
                    sink = pq.ParquetWriter(f"{folder}/{name}", MESSAGE, filesystem=fs)
                sink.write_batch(pa.RecordBatch.from_arrays(
                    [b.column(c).cast(pa.string()) for c in MESSAGE.names], schema=MESSAGE))
        finally:
            if sink is not None:
                sink.close()
        return Written(name)

    def commit(self, producer: str, number: int, messages) -> bool:
        """Make the segments visible; False, and they are removed, where this commit is there already."""
        fs, folder = self.at(producer, "commits")
        fs.create_dir(folder)
        path = f"{folder}/{number:020d}.json"
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            self.remove(producer, messages)
            return False
        part = f"{folder}/.{number}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())
        fs.move(part, path)
        return True

    def remove(self, producer: str, messages) -> None:
        for m in messages:
            if m and m.name:
                fs, path = self.at(producer, "data", m.name)
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)


class StreamReader(DataSourceStreamReader):
    def __init__(self, log: Log, starting: str):
        self.log, self.starting = log, starting

    def initialOffset(self) -> dict:
        return self.log.ends() if self.starting == "latest" else {}

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict):
        return self.log.between(start, end)

    def read(self, partition: Segment):
        return self.log.rows(partition)

    def commit(self, end: dict) -> None:
        """Other readers may still be behind, so nothing is removed."""


class Reader(DataSourceReader):
    def __init__(self, log: Log):
        self.log = log

    def partitions(self):
        return self.log.between({}, self.log.ends())

    def read(self, partition: Segment):
        # an empty log has one partition without a segment
        return self.log.rows(partition) if isinstance(partition, Segment) else iter([])


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, log: Log, producer: str):
        self.log, self.producer = log, producer

    def write(self, iterator) -> Written:
        return self.log.write(self.producer, iterator)

    def commit(self, messages, batchId: int) -> None:
        self.log.commit(self.producer, batchId, messages)

    def abort(self, messages, batchId: int) -> None:
        self.log.remove(self.producer, messages)


class Writer(DataSourceArrowWriter):
    def __init__(self, log: Log, producer: str):
        self.log, self.producer = log, producer

    def write(self, iterator) -> Written:
        return self.log.write(self.producer, iterator)

    def commit(self, messages) -> None:
        number = self.log.ends().get(self.producer, 0)
        if not self.log.commit(self.producer, number, messages):
            raise RuntimeError(f"commit {number} of {self.producer} was written by another job: one job writes as one producer")

    def abort(self, messages) -> None:
        self.log.remove(self.producer, messages)


class EventLog(DataSource):
    """Options: path; startingOffsets (earliest, latest) for readers; producer for writers."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def log(self) -> Log:
        if not self.options.get("path"):
            raise ValueError("event_log needs a path")
        return Log(self.options["path"])

    def producer(self) -> str:
        name = self.options.get("producer", "main")
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a producer's name: {name!r}")
        return name

    def reader(self, schema) -> Reader:
        return Reader(self.log())

    def streamReader(self, schema) -> StreamReader:
        starting = self.options.get("startingoffsets", "latest")
        if starting not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets is earliest or latest, not {starting!r}")
        return StreamReader(self.log(), starting)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("the log is append-only")
        return Writer(self.log(), self.producer())

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.log(), self.producer())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log as a batch table."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def log_stream(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("startingOffsets", starting).load(path)


def events_of(messages: DataFrame) -> DataFrame:
    """Transaction events from the JSON values; a value that is no object gives a row of nulls."""
    return messages.select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")


def append_log(messages: DataFrame, path: str, producer: str = "main") -> None:
    """Appends key, value as one commit."""
    register(messages.sparkSession)
    messages.select("key", "value").write.format(FORMAT).option("producer", producer).mode("append").save(path)


def write_log_stream(messages: DataFrame, path: str, checkpoint: str, producer: str = "main", available_now: bool = True):
    """Streaming sink: every micro-batch is one commit."""
    register(messages.sparkSession)
    w = (messages.select("key", "value").writeStream.format(FORMAT).option("producer", producer)
         .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()
