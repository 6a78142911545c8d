"""Server-sent events in landed files as a data source, for batches and streams.

A file is one stream that may still grow. Its frames are blocks that a blank line ends (``event:`` and ``data:`` lines, framing
``blocks``) or single ``data:`` lines (framing ``lines``). A frame belongs to the byte range in which it *ends*: a task begins
at the last border before its range and stops at the last border inside it, so any cut of a file into ranges gives the same
frames. Hence a batch reads large files by many tasks, and a stream needs no buffer: its offset is the length of each file that
was read, and what stood behind the last border is read again, as the beginning of a frame, when more bytes arrive. What no
border ends is left out in both.

``until_complete`` then ends each stream at its first event of the closing type, in a batch by a window, in a stream by state.

Lines end in LF or CR LF. Blocks without data are left out; several data lines of a block are joined by line ends; the event's
name is ``message`` without one. Bytes that are not UTF-8 become replacement characters. A folder without files is an empty
table. File systems are those of pyarrow (local and mounted paths, hdfs://, s3://, gs://)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SCHEMA = "stream string, position long, event string, data string"
#: Bytes of a task's range, and of one read.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_sizes(path: str) -> dict[str, int]:
    """Sizes of the files of a folder, by name."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}


def _border_before(file, at: int, blocks: bool) -> int:
    """Where the frame begins that goes on at byte ``at``: behind the last border that ends there or earlier."""
    end = at
    while end > 0:
        start = max(0, end - READ_BYTES)
        file.seek(start)
        data = file.read(min(at, end + 3) - start)  # a border may lie across two reads
        found = max((data.rfind(mark) + len(mark) for mark in ((b"\n\n", b"\n\r\n") if blocks else (b"\n",)) if mark in data), default=-1)
        if found >= 0:
            return start + found
        end = start
    return 0


def _lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(end, line) of every line from ``start`` that a line end closes."""
    file.seek(start)
    at, rest = start, b""
    while data := file.read(READ_BYTES):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            at += len(line) + 1
            yield at, line.removesuffix(b"\r")


def _value(line: bytes, name: bytes) -> bytes | None:
    if not line.startswith(name):
        return None
    return line[len(name) :].removeprefix(b" ")


def frames(file, start: int, stop: int, blocks: bool) -> Iterator[tuple[int, str, str]]:
    """(position, event, data) of the frames that end in (start, stop]."""
    border = _border_before(file, start, blocks) if start else 0
    position, event, data = border, None, []
    for end, line in _lines(file, border):
        if end > stop:
            return
        name, part = _value(line, b"event:"), _value(line, b"data:")
        if name is not None:
            event = name
        if part is not None:
            data.append(part)
        if blocks and line:
            continue
        if end > start and data and any(data):
            yield position, (event or b"message").decode("utf-8", "replace").strip(), b"\n".join(data).decode("utf-8", "replace")
        position, event, data = end, None, []


class _Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


def _ranges(before: dict[str, int], after: dict[str, int], split: int) -> list[_Range]:
    return [_Range(name, a, min(a + split, size)) for name, size in sorted(after.items()) for a in range(before.get(name, 0), size, split)]


class _Frames:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.blocks = options.get("framing", "blocks") == "blocks"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.most = int(options.get("maxbytesperbatch", 1 << 62))

    def read(self, partition: _Range) -> Iterator[tuple[str, int, str, str]]:
        system, root = _system(self.path)
        with system.open_input_file(f"{root.rstrip('/')}/{partition.name}") as file:
            for frame in frames(file, partition.start, partition.stop, self.blocks):
                yield partition.name, *frame


class EventReader(_Frames, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return _ranges({}, file_sizes(self.path), self.split)


class EventStreamReader(_Frames, DataSourceStreamReader):
    """Offsets are the bytes of each file that were read; a batch takes at most ``maxBytesPerBatch`` of each."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.reached = {name: min(size, self.reached.get(name, 0) + self.most) for name, size in file_sizes(self.path).items()}
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.reached = {**self.reached, **{k: max(v, self.reached.get(k, 0)) for k, v in end.items()}}  # also after a restart
        return _ranges(start, end, self.split)

    def commit(self, end: dict) -> None:
        pass


class EventFiles(DataSource):
    """Format ``event_files`` with options path, framing (blocks, lines), splitBytes and maxBytesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EventReader:
        return EventReader(dict(self.options))

    def streamReader(self, schema: StructType) -> EventStreamReader:
        return EventStreamReader(dict(self.options))


def event_files(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    """(stream, position, event, data) of the events below a folder; ``position`` is the byte where an event's frame begins."""
    spark.dataSource.register(EventFiles)
    reader = (spark.readStream if stream else spark.read).format("event_files")
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


class _Closing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "position long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if self.closed.exists():
            return
        for row in sorted(rows, key=lambda r: r.position):
            yield Row(stream=row.stream, position=row.position, event=row.event, data=row.data)
            if row.closes:
                self.closed.update((row.position,))
                return


def closes(kind: str = "complete") -> Column:
    """Whether an event closes its stream: by its name, or by the type in its data."""
    return F.coalesce((F.col("event") == kind) | (F.get_json_object("data", "$.type") == kind), F.lit(False))


def until_complete(events: DataFrame, kind: str = "complete") -> DataFrame:
    """Events (stream, position, event, data) up to the first closing one of each stream, itself included."""
    marked = events.select("stream", "position", "event", "data", closes(kind).alias("closes"))
    if events.isStreaming:
        return marked.groupBy("stream").transformWithState(_Closing(), SCHEMA, "append", "None")
    end = F.min(F.when(F.col("closes"), F.col("position"))).over(Window.partitionBy("stream"))
    return marked.withColumn("_end", end).where("_end is null or position <= _end").drop("_end", "closes")
