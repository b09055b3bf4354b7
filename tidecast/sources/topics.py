"""A topic log in a shared folder: a Python data source and sink for streams and batches.

Rows are (topic, offset, value). A sink's tasks write one Parquet file for each topic and task; when all have
ended, one commit file names them with their first offsets and the topics' new ends. What no commit names does
not exist for readers, so a batch appears whole or not at all. A commit also carries each writer's newest batch,
so a replayed batch is not appended again. Offsets count from 0 in each topic, in the order of commits, then tasks.

A stream starts at ``startingOffsets`` (``earliest``, the default, ``latest``, ``committed`` or JSON by topic)
and reads up to the newest commit, at most ``maxOffsetsPerBatch`` rows of a topic a batch; a range of offsets
becomes a partition for each file it meets. What a batch has read is told to ``group``'s file when Spark commits
it, from where another stream of that group can go on with ``committed``.

One writer at a time appends to a log; any number read it. Paths are given as Spark gives them (``file:``,
``hdfs:``, ``s3:`` ...) and opened by Arrow's file systems, on the driver and in tasks.

Defined cases: a null topic is refused, a null value is kept, an empty batch appends nothing, a topic without rows
has end 0, and an empty log gives an empty table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "topic_log"
SCHEMA = "topic STRING, offset BIGINT, value STRING"
ROWS_AT_ONCE = 10_000


class Log:
    """The files of one log."""

    def __init__(self, path: str):
        where = path if "://" in path else "file://" + (path.removeprefix("file:") if path.startswith("file:") else path)
        self.fs, self.root = pafs.FileSystem.from_uri(where)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def write(self, name: str, content: dict) -> None:
        """Written aside and moved, so that a reader meets a whole file or none."""
        self.fs.create_dir(f"{self.root}/{name.rsplit('/', 1)[0]}", recursive=True)
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/drafts", recursive=True)
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(content).encode("utf-8"))
        self.fs.move(draft, f"{self.root}/{name}")

    def commits(self) -> list[str]:
        return self.names("commits")

    def newest(self) -> dict:
        found = self.commits()
        return self.read(f"commits/{found[-1]}") if found else {"number": -1, "ends": {}, "writers": {}, "files": []}

    def append(self, writer: str, batch: int | None, files: list[tuple[str, str, int]]) -> None:
        """Commit (topic, file, rows), in their order."""
        last = self.newest()
        if batch is not None and last["writers"].get(writer, -1) >= batch:
            self.drop([f for _, f, _ in files])
            return
        ends, made = dict(last["ends"]), []
        for topic, name, rows in files:
            made.append({"topic": topic, "file": name, "first": ends.get(topic, 0), "rows": rows})
            ends[topic] = ends.get(topic, 0) + rows
        writers = last["writers"] if batch is None else {**last["writers"], writer: batch}
        if made or writers != last["writers"]:
            number = last["number"] + 1
            self.write(f"commits/{number:012d}.json", {"number": number, "ends": ends, "writers": writers, "files": made})

    def drop(self, files) -> None:
        for name in files:
            self.fs.delete_file(f"{self.root}/{name}")

    def parts(self, start: dict, end: dict) -> list["Part"]:
        """The pieces of files that hold [start, end) of each topic; commits are read from the newest back."""
        need = {t for t, e in end.items() if e > start.get(t, 0)}
        out = []
        for name in reversed(self.commits()):
            if not need:
                break
            commit = self.read(f"commits/{name}")
            for f in commit["files"]:
                low, high = max(start.get(f["topic"], 0), f["first"]), min(end.get(f["topic"], 0), f["first"] + f["rows"])
                if low < high:
                    out.append(Part(f["topic"], f["file"], low, low - f["first"], high - low))
            firsts = {}
            for f in commit["files"]:
                firsts[f["topic"]] = min(firsts.get(f["topic"], f["first"]), f["first"])
            need -= {t for t, first in firsts.items() if first <= start.get(t, 0)}
        return sorted(out, key=lambda p: (p.topic, p.offset))


@dataclass
class Part(InputPartition):
    topic: str
    file: str
    offset: int
    skip: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list


def _read(path: str, part: Part):
    """The rows of a piece, a bounded number at a time."""
    log, at = Log(path), 0
    with log.fs.open_input_file(f"{log.root}/{part.file}") as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=ROWS_AT_ONCE, columns=["value"]):
            low, high = max(part.skip - at, 0), min(part.skip + part.rows - at, batch.num_rows)
            if low < high:
                first = part.offset + at + low - part.skip
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.topic] * (high - low), pa.string()), pa.array(range(first, first + high - low), pa.int64()),
                     batch.column(0).slice(low, high - low)], names=["topic", "offset", "value"])
            at += batch.num_rows


def _wanted(options: dict, ends: dict) -> dict:
    topics = [t.strip() for t in options.get("topics", "").split(",") if t.strip()]
    return {t: ends.get(t, 0) for t in topics} if topics else dict(ends)


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.path = options, options["path"]

    def partitions(self):
        ends = _wanted(self.options, Log(self.path).newest()["ends"])
        return Log(self.path).parts({}, ends) or [Part("", "", 0, 0, 0)]

    def read(self, partition):
        return _read(self.path, partition) if partition.rows else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.path = options, options["path"]
        self.most = int(options["maxOffsetsPerBatch"]) if "maxoffsetsperbatch" in {k.lower() for k in options} else None
        self.seen: dict = {}

    def initialOffset(self):
        how, log = self.options.get("startingOffsets", "earliest"), Log(self.path)
        if how == "earliest":
            self.seen = {}
        elif how == "latest":
            self.seen = _wanted(self.options, log.newest()["ends"])
        elif how == "committed":
            name = f"{self.options['group']}.json"
            self.seen = log.read(f"groups/{name}") if name in log.names("groups") else {}
        else:
            self.seen = {t: int(n) for t, n in json.loads(how).items()}
        return dict(self.seen)

    def latestOffset(self):
        ends = _wanted(self.options, Log(self.path).newest()["ends"])
        if self.most:
            ends = {t: min(e, self.seen.get(t, 0) + self.most) for t, e in ends.items()}
        return ends

    def partitions(self, start, end):
        self.seen = dict(end)
        return Log(self.path).parts(start, end) or [Part("", "", 0, 0, 0)]

    def read(self, partition):
        return _read(self.path, partition) if partition.rows else iter(())

    def commit(self, end):
        self.seen = dict(end)
        if self.options.get("group"):
            Log(self.path).write(f"groups/{self.options['group']}.json", end)


class _Writer:
    def __init__(self, options):
        self.options, self.path, self.writer = options, options["path"], options.get("writer", "default")

    def write(self, iterator):
        from pyspark import TaskContext

        log, open_files, held, counts = Log(self.path), {}, {}, {}
        schema = pa.schema([("value", pa.string())])
        log.fs.create_dir(f"{log.root}/data", recursive=True)

        def flush(topic):
            open_files[topic][1].write_table(pa.table({"value": pa.array(held[topic], pa.string())}))
            held[topic] = []

        for row in iterator:
            if row["topic"] is None:
                raise ValueError("a message needs a topic")
            topic = row["topic"]
            if topic not in open_files:
                name = f"data/{uuid.uuid4().hex}.parquet"
                open_files[topic] = name, pq.ParquetWriter(f"{log.root}/{name}", schema, filesystem=log.fs)
                held[topic], counts[topic] = [], 0
            held[topic].append(row["value"])
            counts[topic] += 1
            if len(held[topic]) >= ROWS_AT_ONCE:
                flush(topic)
        for topic, (_, out) in open_files.items():
            flush(topic)
            out.close()
        return Written(TaskContext.get().partitionId(), [(t, name, counts[t]) for t, (name, _) in open_files.items()])

    def _commit(self, messages, batch):
        told = sorted((m for m in messages if m), key=lambda m: m.task)
        Log(self.path).append(self.writer, batch, [tuple(f) for m in told for f in m.files])

    def _abort(self, messages):
        Log(self.path).drop([f[1] for m in messages if m for f in m.files])


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages):
        self._commit(messages, None)

    def abort(self, messages):
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self._commit(messages, batchId)

    def abort(self, messages, batchId):
        self._abort(messages)


class TopicLog(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return BatchReader(self.options)

    def streamReader(self, schema: StructType):
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("a topic log is only appended to")
        return BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool):
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("topic_log")`` known; the classes travel to the tasks by value."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TopicLog)


def ends(path: str) -> dict[str, int]:
    """The next offset of each topic."""
    return Log(path).newest()["ends"]
