"""Event streams as a Spark data source and sink, ``veridoc_events``.

A log is a folder of numbered batches; in a batch stand the parts of streams that came with it:

    <path>/000000000007/<stream id, quoted>.00000     bytes of frames "event:<name>\\ndata:<json>\\n\\n"; what others write
    <path>/000000000007/@00000-<any>                  a segment, what a task of Spark writes: parts of many streams and their index
    <path>/000000000007/_COMMITTED                    written last; a batch without it does not exist. Lists the segments

A stream is what its parts hold, one after another by batch and number, those in segments after the others of a batch. Files of one
stream may be cut anywhere, within a frame or a character: a frame counts to the range of bytes in which it ends, and whoever
reads that range looks back for where it starts. A segment's parts are whole frames, sorted by stream. So an offset of a
streaming read is a batch number, tasks share a long stream by ranges of bytes, and no stream is one row. Files and tasks of
what Spark has written grow with its bytes, not with the number of streams; the index of a segment is read by the tasks that need it.

Columns: stream_id, position (the byte at which the frame starts), event, and the fields of the frame's JSON. A frame without
event or data is none. One whose data is no JSON object is an ``error`` row with a message.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from veridoc.streaming.events import FIELDS

NAME, MARK = "veridoc_events", "_COMMITTED"
#: What the names of segments start with; quoted stream ids never have it.
SEGMENT = "@"
SCHEMA = f"stream_id string, position long, event string, {FIELDS}"
#: Bytes of a stream that one task reads, and that it looks back at a time.
RANGE, BACK = 8 << 20, 64 << 10
_BREAK = re.compile(rb"\r?\n\r?\n")
_FIELDS = [tuple(f.split()) for f in FIELDS.split(", ")]
# Fixed value: what a stream that breaks off says.
BROKEN_OFF = "the stream broke off before it was completed or failed"


def _fs(path: str):
    """The file system of a path or URI and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _batches(path: str) -> list[int]:
    from pyarrow import fs

    store, base = _fs(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    numbers = sorted(int(f.base_name) for f in found if f.base_name.isdigit())
    marks = store.get_file_info([f"{base}/{n:012d}/{MARK}" for n in numbers]) if numbers else []
    return [n for n, m in zip(numbers, marks, strict=True) if m.type != fs.FileType.NotFound]


def _parts(path: str, batches: list[int]) -> dict[str, list[tuple[str, int, int]]]:
    """Files, with 0 and their sizes, of each stream that has some in the batches, in order."""
    from pyarrow import fs

    store, base = _fs(path)
    found: dict[str, list[tuple[str, int]]] = {}
    for n in batches:
        files = [f for f in store.get_file_info(fs.FileSelector(f"{base}/{n:012d}")) if f.is_file and f.base_name != MARK and f.base_name[0] != SEGMENT]
        for f in sorted(files, key=lambda f: f.base_name):
            found.setdefault(unquote(f.base_name.rpartition(".")[0]), []).append((f"{n:012d}/{f.base_name}", 0, f.size))
    return found


@dataclass
class Segment:
    """A segment as its batch's mark lists it: bytes of frames, bytes of the index after them, least and greatest id of its streams."""

    batch: int
    name: str
    bytes: int
    index: int
    least: str
    most: str


def _segments(path: str, batches: list[int]) -> list[Segment]:
    """The segments of the batches, in order."""
    store, base = _fs(path)
    found = []
    for n in batches:
        with store.open_input_file(f"{base}/{n:012d}/{MARK}") as f:
            listed = f.read()
        found += [Segment(n, f"{n:012d}/{name}", *rest) for name, *rest in sorted(json.loads(listed or b"[]"))]
    return found


def _index(path: str, segment: Segment) -> list[tuple[str, int, int]]:
    """(stream, offset, size) of the parts in a segment, in order."""
    store, base = _fs(path)
    with store.open_input_file(f"{base}/{segment.name}") as f:
        packed = f.read_at(segment.index, segment.bytes)
    return [tuple(x) for x in json.loads(zlib.decompress(packed))]


class Bytes:
    """Ranges of a stream's bytes over its parts (file, offset in it, size)."""

    def __init__(self, path: str, parts: list[tuple[str, int, int]]):
        self.store, self.base = _fs(path)
        self.parts = parts

    def read(self, start: int, stop: int) -> bytes:
        out, at = [], 0
        for name, offset, size in self.parts:
            a, b = max(start, at), min(stop, at + size)
            if a < b:
                with self.store.open_input_file(f"{self.base}/{name}") as f:
                    out.append(f.read_at(b - a, offset + a - at))
            at += size
        return b"".join(out)


class Held:
    """The same for bytes that are in memory, of which the first stands at ``at``."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at = data, at

    def read(self, start: int, stop: int) -> bytes:
        return bytes(self.data[start - self.at : stop - self.at])


def frames(data: Bytes, start: int, stop: int, last: bool) -> Iterator[tuple[int, bytes]]:
    """(position, frame) of the frames that end after ``start`` and at or before ``stop``. A frame starts at the first byte
    that is no line end and ends with the first empty line after it; with ``last`` also where the stream stops."""
    at, held = start, b""
    while at > 0:  # back to a break that ends at or before the range
        back = max(0, at - BACK)
        held, at = data.read(back, at) + held, back
        found = list(_BREAK.finditer(held[: start - at]))
        if found:
            held, at = held[found[-1].end() :], at + found[-1].end()
            break
    held += data.read(start, stop)
    place = 0
    while place < len(held):
        if held[place] in b"\r\n":
            place += 1
            continue
        end = _BREAK.search(held, place)
        if end is None:
            if last:
                yield at + place, held[place:]
            return
        if at + end.end() > start:
            yield at + place, held[place : end.start()]
        place = end.end()


def parsed(frame: bytes) -> dict | None:
    """Event name and fields of a frame; None if it has no event or no data."""
    lines = frame.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    event = next((x[6:].strip() for x in lines if x.startswith("event:")), "")
    data = "\n".join(x[5:].lstrip() for x in lines if x.startswith("data:"))
    if not event or not data:
        return None
    try:
        body = json.loads(data)
    except ValueError:
        body = None
    if not isinstance(body, dict):
        return {"event": "error", "message": f"the data of {event} is no JSON object", "recoverable": False}
    kinds = {"int": int, "string": str, "boolean": bool}
    return {"event": event} | {n: body[n] for n, k in _FIELDS if isinstance(body.get(n), kinds[k])}


@dataclass
class Range:
    """Bytes of one stream over its parts."""

    stream: str
    parts: list
    start: int
    stop: int
    last: bool

    def rows(self, path: str) -> Iterator[tuple[str, int, bytes]]:
        for position, frame in frames(Bytes(path, self.parts), self.start, self.stop, self.last):
            yield self.stream, position, frame


@dataclass
class Slice:
    """Bytes of one segment, the segments before it that have some of its streams, and streams that are not to be read here."""

    segment: Segment
    start: int
    stop: int
    before: list
    other: frozenset

    def rows(self, path: str) -> Iterator[tuple[str, int, bytes]]:
        store, base = _fs(path)
        mine = [(s, a, n) for s, a, n in _index(path, self.segment) if a < self.stop and a + n > self.start and s not in self.other]
        had = dict.fromkeys((s for s, _, _ in mine), 0)
        for old in self.before:
            if had and old.least <= mine[-1][0] and old.most >= mine[0][0]:
                for s, _, n in _index(path, old):
                    if s in had:
                        had[s] += n
        with store.open_input_file(f"{base}/{self.segment.name}") as f:
            held = memoryview(f.read_at(self.stop - self.start, self.start))
        for stream, at, size in mine:
            a, b = max(self.start, at), min(self.stop, at + size)
            inside = Held(held[a - self.start : b - self.start], a - at)
            whole = inside if a == at else Bytes(path, [(self.segment.name, at, size)])  # a cut part is looked back into
            for position, frame in frames(whole, a - at, b - at, False):
                yield stream, had[stream] + position, frame


@dataclass
class Task(InputPartition):
    """Ranges and slices that one task reads."""

    reads: list = field(default_factory=list)
    size: int = 0

    def __post_init__(self):
        super().__init__(None)


def ranges(path: str, after: int | None, upto: int | None) -> list[Task]:
    """What to read of the batches after one and up to another; all batches, if None. A task has about RANGE bytes at most."""
    batches = [n for n in _batches(path) if upto is None or n <= upto]
    new, old = [n for n in batches if after is None or n > after], [n for n in batches if after is not None and n <= after]
    segments, files = _segments(path, batches), {n: _parts(path, [n]) for n in batches}
    # streams that also have files of their own are few or the caller's; their parts in segments are ranges like the others
    alone = frozenset(s for found in files.values() for s in found)
    for g in segments if alone else ():
        if any(g.least <= s <= g.most for s in alone):
            for s, at, size in _index(path, g):
                if s in alone:
                    files[g.batch].setdefault(s, []).append((g.name, at, size))
    parts = lambda some: {s: [p for n in some for p in files[n].get(s, [])] for s in sorted({s for n in some for s in files[n]})}
    before = parts(old)
    out: list[Task] = []

    def add(read: Range | Slice) -> None:
        if not out or out[-1].size + read.stop - read.start > RANGE:
            out.append(Task())
        out[-1].reads.append(read)
        out[-1].size += read.stop - read.start

    for stream, own in parts(new).items():
        had = before.get(stream, [])
        begin = sum(size for _, _, size in had)
        end = begin + sum(size for _, _, size in own)
        for a in range(begin, end, RANGE):
            b = min(a + RANGE, end)
            add(Range(stream, had + own, a, b, upto is None and b == end))
    for k, g in enumerate(segments):
        if after is None or g.batch > after:
            some = [x for x in segments[:k] if x.least <= g.most and x.most >= g.least]
            for a in range(0, g.bytes, RANGE):
                add(Slice(g, a, min(a + RANGE, g.bytes), some, alone))
    return out


class _Reader:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Task | None) -> Iterator[tuple]:
        for part in partition.reads if partition else ():  # Spark asks once with None for a log without ranges
            for stream, position, frame in part.rows(self.path):
                if (row := parsed(frame)) is not None:
                    yield (stream, position, row["event"], *(row.get(n) for n, _ in _FIELDS))


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Task]:
        return ranges(self.path, None, None)


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_batches(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return ranges(self.path, start["batch"], end["batch"])

    def commit(self, end: dict) -> None:
        pass


def framed(event: str, body: dict) -> bytes:
    data = json.dumps({k: v for k, v in body.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
    return f"event:{event}\ndata:{data}\n\n".encode()


@dataclass
class Written(WriterCommitMessage):
    segment: list


class _Writer:
    """Each attempt of a task writes a segment under a name of its own; the driver's commit lists those that count, and so makes the batch exist."""

    def __init__(self, path: str, columns: list[str], batch: int | None = None):
        self.path, self.columns = path, columns
        self.number = max(_batches(path), default=-1) + 1 if batch is None else batch

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, base = _fs(self.path)
        folder, name = f"{base}/{self.number:012d}", f"{SEGMENT}{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        index: list[list] = []
        out, at, own = None, 0, [c for c in self.columns if c not in ("stream_id", "event", "position", "seq")]
        for row in rows:
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
            if not index or row["stream_id"] != index[-1][0]:
                index.append([row["stream_id"], at, 0])
            out.write(data := framed(row["event"], {c: row[c] for c in own}))
            at += len(data)
            index[-1][2] += len(data)
        if out is None:
            return Written([])
        out.write(packed := zlib.compress(json.dumps(index).encode()))
        out.close()
        return Written([name, at, len(packed), index[0][0], index[-1][0]])

    def _mark(self, number: int, segments: list[list]) -> None:
        store, base = _fs(self.path)
        store.create_dir(f"{base}/{number:012d}", recursive=True)
        with store.open_output_stream(f"{base}/{number:012d}/{MARK}") as f:
            f.write(json.dumps(segments).encode())


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        self._mark(self.number, [m.segment for m in messages if m is not None and m.segment])


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only added to")
        return BatchWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def write(events: DataFrame, path: str) -> None:
    """Adds events (stream_id, seq and the fields) as a batch. Tasks hold ranges of (stream_id, seq), so a long stream is
    written by many of them and its parts stand in order."""
    register(events.sparkSession)
    parts = events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    events.repartitionByRange(int(parts), "stream_id", "seq").sortWithinPartitions("stream_id", "seq").write.format(NAME).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log as it stands; streams count as whole, so what follows the last empty line is an event too."""
    register(spark)
    return spark.read.format(NAME).option("path", path).load()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log as they come, each in the micro-batch in which its last byte does."""
    register(spark)
    return spark.readStream.format(NAME).option("path", path).load()


def with_broken(events: DataFrame) -> DataFrame:
    """The events, and an ``error`` row at the end of each stream that has no ending event."""
    ends = events.groupBy("stream_id").agg(F.bool_or(F.col("event").isin("completed", "error")).alias("_ended"), F.max("position").alias("_last"))
    lost = ends.filter("not _ended").select("stream_id", (F.col("_last") + 1).alias("position"), F.lit("error").alias("event"), F.lit(BROKEN_OFF).alias("message"), F.lit(True).alias("recoverable"))
    return events.unionByName(lost, allowMissingColumns=True)


def numbered(events: DataFrame) -> DataFrame:
    """``seq`` from 0 for the events of each stream in order. Rows are numbered within ranges of RANGE bytes, and the ranges'
    counts, a short row each, are summed up, so a long stream does not meet in one task."""
    cell = events.withColumn("_r", F.floor(F.col("position") / RANGE))
    before = cell.groupBy("stream_id", "_r").agg(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(Window.partitionBy("stream_id").orderBy("_r")) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy("stream_id", "_r").orderBy("position")) - 1
    return cell.withColumn("_k", within).join(before, ["stream_id", "_r"]).withColumn("seq", (F.col("_n") + F.col("_k")).cast("long")).drop("_r", "_n", "_k")
