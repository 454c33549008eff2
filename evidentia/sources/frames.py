"""Trace frames out of event-stream files, in batch and as a stream.

A frame is some lines up to a blank one: ``event: name``, one or more ``data: text`` lines that belong together, comments
and fields of no interest. Files are read in byte ranges by as many tasks; a frame belongs to the range that its first
byte lies in, and the task of that range reads on behind its end until the frame is whole. As a stream, a file is read as
far as its last whole frame, and further when it has grown.

Lines may end in any of the three ways. A frame that a file breaks off in, and one without data, is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from evidentia.functions.ship import ship

FORMAT = "trace_frames"
SCHEMA = "file string, position bigint, event string, data string"
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
#: Frames handed on at a time.
HELD = 4096
_BLANK = re.compile(rb"(?:\r\n|\n|\r(?!\n)){2,}")
_LINE_END = re.compile(rb"\r\n|\n|\r")
#: Bytes before a range that tell whether a frame starts with it.
_LOOK_BACK = 4


def parse_frame(raw: bytes) -> tuple[str | None, str] | None:
    """Name and data of a frame, or None if it has no data."""
    event, data = None, []
    for line in _LINE_END.split(raw):
        name, _, value = line.partition(b":")
        value = value.removeprefix(b" ").decode("utf-8", "replace")
        if name == b"event":
            event = value
        elif name == b"data":
            data.append(value)
    return (event, "\n".join(data)) if data else None


def frames_between(stream, start: int, end: int, size: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of the whole frames of a file of ``size`` bytes that start in ``[start, end)``."""
    place = max(0, start - _LOOK_BACK)
    stream.seek(place)
    held, at = b"", place  # bytes not yet used, and where they are in the file
    opened = start == 0
    while at < end:
        found = _BLANK.search(held)
        # Line ends at the edge of what was read may go on behind it.
        while (found is None or found.end() == len(held)) and at + len(held) < size:
            more = stream.read(min(block, size - at - len(held)))
            if not more:
                break
            held += more
            found = _BLANK.search(held)
        if found is None:
            return
        if opened and found.start() > 0 and start <= at:
            yield at, held[:found.start()]
        at, held = at + found.end(), held[found.end():]
        opened = True


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


def _sizes(path: str) -> dict[str, int]:
    """Files at or below a path, those in progress left out."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
    return {i.path: i.size for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}


def _open(path: str, file: str):
    store, _ = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return store.open_input_file(file)


def _ranges(file: str, start: int, end: int, step: int) -> list[Range]:
    return [Range(file, a, min(a + step, end), end) for a in range(start, end, step)]


class _Reading:
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "position", "event", "data"])

        with _open(self.path, part.file) as stream:
            for at, raw in frames_between(stream, part.start, part.end, part.size):
                frame = parse_frame(raw.removeprefix(b"\xef\xbb\xbf") if at == 0 else raw)
                if frame:
                    rows.append((part.file, at, *frame))
                if len(rows) >= HELD:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class FrameReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(_sizes(self.path).items()) for r in _ranges(file, 0, size, self.step)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.end else iter(())


class FrameStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are, for each file, the end of its last whole frame."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, file: str, size: int) -> int:
        """Where the last whole frame ends; only the tail of the file is looked at."""
        with _open(self.path, file) as stream:
            tail = BLOCK_BYTES
            while True:
                start = max(0, size - tail)
                stream.seek(start)
                last = None
                for last in _BLANK.finditer(stream.read(size - start)):
                    pass
                if last or not start:
                    return start + last.end() if last else 0
                tail *= 2

    def latestOffset(self) -> dict:
        return {file: max(self.known.get(file, 0), self._whole(file, size)) for file, size in _sizes(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, last in sorted(end.items()) for r in _ranges(file, start.get(file, 0), last, self.step)]

    def commit(self, end: dict) -> None:
        self.known = dict(end)


class FrameSource(DataSource):
    """``spark.read.format("trace_frames").load(path)``, or ``readStream``; the option ``rangeBytes`` sets the ranges."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> FrameStreamReader:
        return FrameStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and its executors."""
    ship(spark)
    spark.dataSource.register(FrameSource)
