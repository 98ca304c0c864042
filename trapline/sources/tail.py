"""A growing log file as a streaming source: new lines, each once, over rotation and truncation.

A file is known by its first line, not by its name, so a rotated file is read to
its end under its new name and a new file under the old name is read from its
start.  An offset holds, for the file and its rotated siblings, how many bytes of
whole lines there are.  It depends on nothing but the files, so a restarted
query goes on from its checkpoint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "log_tail"
SCHEMA = "value string, file string, position long"
# A task reads about so many bytes; a larger growth is cut at line ends.
PIECE_BYTES = 64 << 20
_CHUNK = 1 << 20
# The first line must end within so many bytes, or the file is not a log yet.
_LONGEST_FIRST = 1 << 20


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or by URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def siblings(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file and its rotated ones (``path.…``); none while it is missing."""
    folder, _, name = path.rpartition("/")
    listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [f for f in listed if f.type == fs.FileType.File and (f.base_name == name or f.base_name.startswith(f"{name}."))]


def identity(system: fs.FileSystem, path: str) -> str | None:
    """A name made from the first line; None while that is not complete."""
    with system.open_input_file(path) as file:
        head = file.read(_LONGEST_FIRST)
    end = head.find(b"\n")
    return None if end < 0 else f"{zlib.crc32(head[:end]):08x}{zlib.adler32(head[:end]):08x}{end:x}"


def whole_lines(system: fs.FileSystem, path: str) -> int:
    """Bytes up to the last line end; a line that is still being written is left for later."""
    with system.open_input_file(path) as file:
        end = file.size()
        while end:
            start = max(0, end - _CHUNK)
            at = file.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def present(path: str) -> dict[str, tuple[str, int]]:
    """By identity: name and bytes of whole lines.  A copy made by rotation counts with its original, the longer of both."""
    system, inner = open_folder(path)
    found: dict[str, tuple[str, int]] = {}
    for info in siblings(system, inner):
        try:
            known, size = identity(system, info.path), whole_lines(system, info.path)
        except FileNotFoundError:  # rotated meanwhile; the next look finds it
            continue
        if known and size > found.get(known, ("", 0))[1]:
            found[known] = (info.path, size)
    return found


@dataclass
class Piece(InputPartition):
    """Lines of one file that begin from ``start`` up to before ``end``."""

    file: str
    start: int
    end: int


def pieces(file: str, start: int, end: int, most: int = PIECE_BYTES) -> Iterator[Piece]:
    while start < end:
        yield Piece(file, start, min(end, start + most))
        start += most


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, begin: str, piece_bytes: int):
        if begin not in ("start", "end"):
            raise ValueError("begin must be start or end")
        self.path, self.begin, self.piece_bytes = path, begin, piece_bytes

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.begin == "end" else {}

    def latestOffset(self) -> dict:
        return {known: size for known, (_, size) in sorted(present(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        found = []
        for known, size in end.items():
            read = start.get(known, 0)
            # A file that has become shorter was written anew.
            found += pieces(known, read if read <= size else 0, size, self.piece_bytes)
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The piece's lines, looked up by the file's identity, for it may have been renamed since."""
        system, _ = open_folder(self.path)
        name, size = present(self.path).get(partition.file, (None, 0))
        if size < partition.end:
            raise RuntimeError(f"{partition.file} of {self.path} was deleted or cut before it was read")
        with system.open_input_file(name) as file:
            yield from lines_of(file, partition)


def lines_of(file: pa.NativeFile, piece: Piece) -> Iterator[pa.RecordBatch]:
    """Batches of the lines that begin in the piece; the last one may end beyond it."""
    at, rest = piece.start, b""
    if at:
        # The line that holds the byte before belongs to the piece before.
        at -= 1
        while True:
            chunk = file.read_at(_CHUNK, at)
            end = chunk.find(b"\n")
            at += len(chunk) if end < 0 else end + 1
            if end >= 0 or not chunk:
                break
    while at < piece.end:
        chunk = file.read_at(_CHUNK, at + len(rest))
        if not chunk:
            return
        block = rest + chunk
        cut = block.rfind(b"\n") + 1
        values, positions, begin = [], [], 0
        while begin < cut and at + begin < piece.end:
            end = block.index(b"\n", begin)
            values.append(block[begin:end].decode("utf-8", "replace"))
            positions.append(at + begin)
            begin = end + 1
        if values:
            columns = [pa.array(values, pa.string()), pa.array([piece.file] * len(values)), pa.array(positions, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "position"])
        if begin < cut:
            return
        at, rest = at + cut, block[cut:]


class LogTail(DataSource):
    """Options: ``path``; ``begin`` (start or end, where a first run begins); ``pieceBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("begin", "start"), int(self.options.get("pieceBytes", PIECE_BYTES)))


def tail_log(spark: SparkSession, path: str, begin: str = "start", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """New whole lines of one log file as a stream: value, file (its identity), position (of the line's first byte).

    The file may not exist yet.  Rotated files must keep the file's name with something after a dot, and
    stay until they are read; what is truncated before it is read is lost.  A file that shrinks and keeps its first line
    is read anew from its start.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format(NAME).option("path", path).option("begin", begin)
    return reader.option("pieceBytes", piece_bytes).load()
