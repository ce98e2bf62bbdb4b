"""Topics as folders, with what a broker gives: atomic appends of a batch, partitions with offsets, and groups that remember theirs.

A topic is a folder of Parquet files that its manifests name. A manifest is one small file for each appended batch; it
appears by a single rename, so a batch is visible as a whole or not at all. It says for each partition which files hold which
offsets, and repeats how far every partition and every writer has come, so that only the last one is read to know the state.

``topic``: a source with consumer groups, and a sink with a commit protocol. ``snapshot_log``: a snapshot of a table, then the changes since.
All paths may be anything that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])
_FILE = pa.schema([("key", pa.string()), ("value", pa.string())])


class Folder:
    """A folder of some file system."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))

    def names(self, sub: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/{sub}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))

    def read_json(self, name: str) -> dict | None:
        if self.fs.get_file_info(f"{self.path}/{name}").type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def put_json(self, name: str, content: dict) -> None:
        """Writes beside, then renames, so that nobody sees half of it."""
        folder, _, own = name.rpartition("/")
        self.fs.create_dir(f"{self.path}/{folder}")
        beside = f"{self.path}/{folder}/.{own}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(beside, f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.path}/{name}").type != pafs.FileType.NotFound:
            self.fs.delete_file(f"{self.path}/{name}")


class Topic:
    """The manifests of a topic. One writer at a time may append."""

    def __init__(self, uri: str):
        self.folder = Folder(uri)

    def last(self) -> tuple[int, dict]:
        names = self.folder.names("log")
        if not names:
            return -1, {"ends": {}, "writers": {}, "files": []}
        return int(names[-1].split(".")[0]), self.folder.read_json(f"log/{names[-1]}")

    def ends(self) -> dict[str, int]:
        return self.last()[1]["ends"]

    def append(self, writer: str, batch: int, files: list[tuple[int, str, int]]) -> bool:
        """Makes files (partition, name, rows) visible, unless this batch of this writer already is."""
        number, state = self.last()
        if state["writers"].get(writer, -1) >= batch:
            return False
        ends, placed = dict(state["ends"]), []
        for partition, name, rows in sorted(files):
            first = ends.get(str(partition), 0)
            placed.append({"partition": partition, "file": name, "first": first, "end": first + rows})
            ends[str(partition)] = first + rows
        self.folder.put_json(f"log/{number + 1:020d}.json", {"ends": ends, "writers": state["writers"] | {writer: batch}, "files": placed})
        return True

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[dict]:
        """Files with offsets from start on and before end, each with the offsets to take; manifests are read from the newest back."""
        out = []
        for name in reversed(self.folder.names("log")):
            manifest = self.folder.read_json(f"log/{name}")
            for f in manifest["files"]:
                a, b = max(f["first"], start.get(str(f["partition"]), 0)), min(f["end"], end.get(str(f["partition"]), 0))
                if a < b:
                    out.append(f | {"from": a, "to": b})
            if all(n <= start.get(p, 0) for p, n in manifest["ends"].items()):
                break
        return out[::-1]


@dataclass
class Piece(InputPartition):
    """Rows ``begin`` to ``end`` of a file, whose first row has the offset ``first``."""

    uri: str
    file: str
    partition: int
    first: int
    begin: int
    end: int


def read_piece(piece: Piece) -> Iterator[pa.RecordBatch]:
    folder = Folder(piece.uri)
    at = 0
    with folder.fs.open_input_file(f"{folder.path}/data/{piece.file}") as f:
        for batch in pq.ParquetFile(f).iter_batches(10_000):
            a, b = max(piece.begin - at, 0), min(piece.end - at, len(batch))
            if a < b:
                own = batch.slice(a, b - a)
                offsets = pa.array(range(piece.first + at + a, piece.first + at + b), pa.int64())
                yield pa.record_batch([own.column("key"), own.column("value"), pa.array([piece.partition] * len(own), pa.int32()), offsets], ["key", "value", "partition", "offset"])
            at += len(batch)


def pieces(uri: str, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
    return [Piece(uri, f["file"], f["partition"], f["first"], f["from"] - f["first"], f["to"] - f["first"]) for f in Topic(uri).between(start, end)]


class GroupReader(DataSourceStreamReader):
    """Reads on from where the group is. Offsets are committed to the topic's ``groups`` folder, apart from the query's checkpoint, once Spark is done with a batch."""

    def __init__(self, options):
        self.uri, self.group, self.starting = options["path"], options.get("group"), options.get("startingOffsets", "earliest")

    def initialOffset(self) -> dict:
        held = Folder(self.uri).read_json(f"groups/{self.group}.json") if self.group else None
        return held if held is not None else {} if self.starting == "earliest" else Topic(self.uri).ends()

    def latestOffset(self) -> dict:
        return self.initialOffset() | Topic(self.uri).ends()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return pieces(self.uri, start, end) or [Piece(self.uri, "", 0, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(partition) if partition.end else iter(())

    def commit(self, end: dict) -> None:
        if self.group:
            commit_group(self.uri, self.group, end)


def commit_group(uri: str, group: str, ends: dict[str, int]) -> None:
    """Moves a group forward, never back."""
    folder = Folder(uri)
    held = folder.read_json(f"groups/{group}.json") or {}
    folder.put_json(f"groups/{group}.json", held | {p: max(n, held.get(p, 0)) for p, n in ends.items()})


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]


class TopicWriter(DataSourceStreamWriter):
    """Tasks write files that nobody sees; the driver makes those of a batch visible together, or removes them.

    ``writer`` names the job, so that a batch which runs again after it was committed, with whatever checkpoint, is left out.
    Rows with equal keys go to one partition; those without a key to the one of the task's first row.
    """

    def __init__(self, options):
        self.uri, self.writer, self.parts = options["path"], options.get("writer", "writer"), int(options.get("partitions", "1"))

    def write(self, iterator: Iterator) -> Written:
        folder, rows = Folder(self.uri), {}
        none = uuid.uuid4().int % self.parts
        files: list[tuple[int, str, int]] = []

        def flush(partition: int) -> None:
            name, own = f"{uuid.uuid4().hex}.parquet", rows.pop(partition)
            table = pa.table({"key": [k for k, _ in own], "value": [v for _, v in own]}, schema=_FILE)
            with folder.fs.open_output_stream(f"{folder.path}/data/{name}") as out:
                pq.write_table(table, out)
            files.append((partition, name, len(own)))

        folder.fs.create_dir(f"{folder.path}/data")
        for row in iterator:
            key = row["key"] if "key" in row else None
            partition = zlib.crc32(key.encode()) % self.parts if key is not None else none
            rows.setdefault(partition, []).append((key, row["value"]))
            if len(rows[partition]) >= 50_000:
                flush(partition)
        for partition in list(rows):
            flush(partition)
        return Written(files)

    def commit(self, messages: list, batchId: int) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if not Topic(self.uri).append(self.writer, batchId, files):
            self.abort(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        folder = Folder(self.uri)
        for m in messages:
            for _, name, _ in m.files if m is not None else ():
                folder.delete(f"data/{name}")


class TopicSource(DataSource):
    """``spark.readStream.format("topic").option("group", ...)`` and ``writeStream.format("topic").option("writer", ...)``, both with a path."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> T.StructType:
        return MESSAGE

    def streamReader(self, schema: T.StructType) -> GroupReader:
        return GroupReader(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options)


class SnapshotReader(DataSourceStreamReader):
    """First all rows of the snapshot, each as a read (``op`` r), then the log from the offsets that the snapshot was taken at."""

    def __init__(self, options):
        self.uri, self.snapshot = options["path"], options["snapshot"]

    def initialOffset(self) -> dict:
        return {"stage": "start", "ends": {}}

    def latestOffset(self) -> dict:
        """The log's end; :meth:`partitions` begins with the snapshot where a query has nothing yet."""
        taken = Folder(self.snapshot).read_json("snapshot.json")
        return {"stage": "log", "ends": taken["ends"] | Topic(self.uri).ends()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, begin = [], start["ends"]
        if start["stage"] == "start":
            taken = Folder(self.snapshot).read_json("snapshot.json")
            begin = taken["ends"]
            out = [Piece(self.snapshot, f["file"], -1, 0, 0, f["rows"]) for f in taken["files"]]
        return out + pieces(self.uri, begin, end["ends"]) or [Piece(self.uri, "", 0, 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_piece(partition) if partition.end else iter(())


class SnapshotSource(DataSource):
    """``spark.readStream.format("snapshot_log")`` with ``path`` of the log and ``snapshot``, the folder of :func:`take_snapshot`.

    Rows of the snapshot have partition -1; both kinds are change messages ({op, before, after}) in ``value``.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot_log"

    def schema(self) -> T.StructType:
        return MESSAGE

    def streamReader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)
    spark.dataSource.register(SnapshotSource)


def append_rows(rows: DataFrame, uri: str, writer: str, batch: int, partitions: int = 1) -> None:
    """Appends the messages (value, and key where there is one) of a batch DataFrame to a topic, all or nothing."""
    options = {"path": uri, "writer": writer, "partitions": str(partitions)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TopicWriter(options).write(r for b in batches for r in b.to_pylist())
        yield pa.record_batch([pa.array([json.dumps(done.files)])], ["files"])

    written = rows.mapInArrow(write, "files string").collect()  # names of files, a few for each task
    TopicWriter(options).commit([Written([tuple(f) for f in json.loads(r.files)]) for r in written], batch)


def take_snapshot(rows: DataFrame, uri: str, snapshot: str) -> None:
    """The rows of a table as read messages beside the offsets that the log has now; changes from there on are not in it."""
    ends = Topic(uri).ends()
    message = F.to_json(F.struct(F.lit("r").alias("op"), F.lit(None).cast("string").alias("before"), F.struct(*rows.columns).alias("after")))
    messages = rows.select(message.alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TopicWriter({"path": snapshot}).write(r for b in batches for r in b.to_pylist())
        yield pa.record_batch([pa.array([json.dumps(done.files)])], ["files"])

    files = [f for r in messages.mapInArrow(write, "files string").collect() for f in json.loads(r.files)]
    Folder(snapshot).put_json("snapshot.json", {"ends": ends, "files": [{"file": name, "rows": n} for _, name, n in files]})
