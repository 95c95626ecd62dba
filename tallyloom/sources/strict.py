"""A data source of text files that takes no invalid byte: for batches and for streams.

    spark.dataSource.register(StrictText)
    spark.read.format("strict_text").load("in")

Rows are task (the file's name), position (the line's first byte) and value (the line without its end, \\n or \\r\\n).
All files directly in the directory are read, also those whose names begin with _ or . (`files`, a pattern of names, takes
some alone); a directory that isn't there or has none is a ValueError. A byte that isn't UTF-8 is a ValueError that names
the file and the byte. A byte-order mark is a character of the first line.

Files are cut into ranges of `range_bytes`; a line belongs to the range that its first byte lies in, and is held whole. Paths
go to pyarrow's file systems, which must be set up on driver and executors.

As a stream, a file may grow and is read as far as its last line end; the offsets are the bytes that were read of each file,
so each line is given out once, and a file that got shorter is an error. They grow with the number of files in the
directory; one that is taken away is forgotten.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
BLOCK = 4 << 20
SCHEMA = pa.schema([("task", pa.string()), ("position", pa.int64()), ("value", pa.string())])


@dataclass
class Range(InputPartition):
    task: str
    first: int
    last: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, pattern: str) -> dict[str, int]:
    """Bytes of each file directly in a directory."""
    system, folder = _system(path)
    try:
        found = system.get_file_info(fs.FileSelector(folder))
    except (FileNotFoundError, NotADirectoryError) as e:
        raise ValueError(f"no input directory {path}") from e
    return {f.base_name: f.size for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)}


def _cut(task: str, first: int, last: int, size: int) -> list[Range]:
    return [Range(task, a, min(a + size, last)) for a in range(first, last, size)]


def _batch(path: str, task: str, positions: list[int], lines: list[bytes]) -> pa.RecordBatch:
    raw = pa.array(lines, pa.binary())
    try:
        values = raw.cast(pa.string())
    except pa.ArrowInvalid:
        for at, line in zip(positions, lines):
            try:
                line.decode()
            except UnicodeDecodeError as e:
                raise ValueError(f"{path}/{task}: byte {at + e.start} isn't UTF-8") from e
        raise
    return pa.RecordBatch.from_arrays([pa.array([task] * len(lines), pa.string()), pa.array(positions, pa.int64()), values], schema=SCHEMA)


def _lines(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, which has no line of its own where a longer one goes through it."""
    system, folder = _system(path)
    with io.BufferedReader(system.open_input_file(f"{folder}/{part.task}"), BLOCK) as f:
        at = part.first
        if at:
            f.seek(at - 1)
            at -= 1
            while at < part.last:  # the line that goes on into the range belongs to one before
                piece = f.readline(BLOCK)
                at += len(piece)
                if piece.endswith(b"\n") or not piece:
                    break
        positions, lines, held = [], [], 0
        while at < part.last:
            line = f.readline()
            if not line:
                break
            positions.append(at)
            at += len(line)
            lines.append(line[: -2 if line.endswith(b"\r\n") else -1] if line.endswith(b"\n") else line)
            held += len(line)
            if held >= BLOCK:
                yield _batch(path, part.task, positions, lines)
                positions, lines, held = [], [], 0
        if lines:
            yield _batch(path, part.task, positions, lines)


def _ended(path: str, task: str, first: int, last: int) -> int:
    """The byte behind the last line end between two bytes of a file, or the first one."""
    system, folder = _system(path)
    with system.open_input_file(f"{folder}/{task}") as f:
        while last > first:
            a = max(first, last - BLOCK)
            f.seek(a)
            at = f.read(last - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            last = a
    return first


class _Batch(DataSourceReader):
    def __init__(self, path: str, pattern: str, size: int) -> None:
        self.path, self.pattern, self.size = path, pattern, size

    def partitions(self) -> list[Range]:
        found = _files(self.path, self.pattern)
        if not found:
            raise ValueError(f"no files in {self.path}")
        return [r for task in sorted(found) for r in _cut(task, 0, found[task], self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition) if partition.last else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, size: int) -> None:
        self.path, self.pattern, self.size = path, pattern, size
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for task, size in sorted(_files(self.path, self.pattern).items()):
            read = self.known.get(task, 0)
            if size < read:
                raise ValueError(f"{self.path}/{task}: {read} bytes were read, and there are {size}")
            read = _ended(self.path, task, read, size)
            if read:
                found[task] = read
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for task, read in end.items():
            if read < start.get(task, 0):
                raise ValueError(f"{self.path}/{task}: {start[task]} bytes were read, and there are {read}")
        return [r for task in sorted(end) for r in _cut(task, start.get(task, 0), end[task], self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class StrictText(DataSource):
    """See above. Options: path, files (a pattern of names, * if not given), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "strict_text"

    def schema(self) -> str:
        return "task string, position long, value string"

    def _told(self) -> tuple[str, str, int]:
        if not self.options.get("path"):
            raise ValueError("a path must be given")
        size = int(self.options.get("range_bytes", RANGE_BYTES))
        if size < 1:
            raise ValueError("range_bytes must be 1 at least")
        return self.options["path"].rstrip("/"), self.options.get("files", "*"), size

    def reader(self, schema) -> _Batch:
        return _Batch(*self._told())

    def streamReader(self, schema) -> _Stream:
        return _Stream(*self._told())
