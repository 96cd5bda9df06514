"""Log files that grow, as a stream: complete lines by byte position, through rotation and truncation.

A file is known by the bytes it begins with, not by its name: a rotated file goes on where it was left, and a new file
under an old name starts at its beginning. Positions are the stream's offsets, so a restarted query goes on exactly where
the last committed batch ended.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256  # first bytes that tell one file from another
BLOCK = 1 << 16  # bytes read at a time when a line end is looked for
TAIL_SCHEMA = "value STRING, source_file STRING, modified_at TIMESTAMP"
_ARROW = pa.schema([("value", pa.string()), ("source_file", pa.string()), ("modified_at", pa.timestamp("us", "UTC"))])


def _line_end_before(file, low: int, high: int) -> int:
    """Position behind the last line end in [low, high), or `low` if there is none."""
    while high > low:
        start = max(low, high - BLOCK)
        found = file.read_at(high - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        high = start
    return low


def _line_end_after(file, low: int, high: int) -> int:
    """Position behind the first line end in [low, high), or `high` if there is none."""
    while low < high:
        block = file.read_at(min(BLOCK, high - low), low)
        found = block.find(b"\n")
        if found >= 0:
            return low + found + 1
        if not block:
            break
        low += len(block)
    return high


def _head(file, size: int) -> int:
    return zlib.crc32(file.read_at(size, 0))


@dataclass
class Piece:
    """Lines of one file that begin in [start, stop); `first` and `last` bound the batch's part of the file."""

    path: str
    name: str
    head: int
    head_size: int
    modified: int
    first: int
    start: int
    stop: int
    last: int


@dataclass
class Pieces(InputPartition):
    """What one task reads: small files together, large ones in pieces."""

    pieces: list[Piece]


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.globs = [g.strip() for g in options.get("files", "*").split(",")]
        self.from_end = options.get("startat", "end") == "end"
        self.most = int(options.get("maxbytesperfile", str(1 << 30)))
        self.chunk = int(options.get("chunkbytes", str(32 << 20)))
        self.fail_on_loss = options.get("failondataloss", "true") == "true"
        self.before: dict | None = None  # the last offset this reader has given out

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def _listed(self, store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        wanted = [f for f in found if f.is_file and any(fnmatch(f.path[len(root) :].lstrip("/"), g) for g in self.globs)]
        return sorted(wanted, key=lambda f: f.path)

    def _offset(self, before: dict, to_end: bool) -> dict:
        """The offset after `before`: each file's position behind its last complete line (at most `most` bytes on)."""
        store, root = self._store()
        left, number, files = dict(before["files"]), before["next"], {}
        listed = self._listed(store, root)
        # a file that still has its name is found first, then those that were renamed
        listed.sort(key=lambda f: not any(e["path"] == f.path for e in left.values()))
        for info in listed:
            with store.open_input_file(info.path) as file:
                size = file.size()
                key = next(iter(sorted(
                    (k for k, e in left.items() if size >= e["at"] and (e["head_size"] or e["path"] == info.path) and _head(file, e["head_size"]) == e["head"]),
                    key=lambda k: (left[k]["path"] != info.path, k))), None)
                if key is None:
                    key, number = f"{number}", number + 1
                    entry = {"name": info.path, "at": 0}
                    if to_end:
                        entry["at"] = _line_end_before(file, 0, size)
                else:
                    entry = dict(left.pop(key))
                    high = min(size, entry["at"] + self.most)
                    end = _line_end_before(file, entry["at"], high)
                    if end == entry["at"] and high < size:  # one line is longer than a batch may be
                        end = _line_end_before(file, end, _line_end_after(file, high, size))
                    entry["at"] = end
                if "path" not in entry and not to_end:  # new: from its beginning on
                    entry["at"] = _line_end_before(file, 0, min(size, self.most)) or _line_end_before(file, 0, _line_end_after(file, 0, size))
                head_size = min(HEAD, entry["at"])
                files[key] = entry | {"path": info.path, "head_size": head_size, "head": _head(file, head_size), "modified": info.mtime_ns // 1000}
        return {"files": files, "next": number}

    def initialOffset(self) -> dict:
        nothing = {"files": {}, "next": 0}
        return self._offset(nothing, True) if self.from_end else nothing

    def latestOffset(self) -> dict:
        if self.before is None:
            self.before = self.initialOffset()
        self.before = self._offset(self.before, False)
        return self.before

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        self.before = end  # a restarted query shows its last offset here before it asks for the next one
        tasks, room = [], 0
        for key, e in end["files"].items():
            first = start["files"].get(key, {"at": 0})["at"]
            for at in range(first, e["at"], self.chunk):
                stop = min(at + self.chunk, e["at"])
                if stop - at > room:
                    tasks.append(Pieces([]))
                    room = self.chunk
                tasks[-1].pieces.append(Piece(e["path"], e["name"], e["head"], e["head_size"], e["modified"], first, at, stop, e["at"]))
                room -= stop - at
        return tasks

    def _open(self, piece: Piece):
        """The file of a piece, wherever it is now."""
        store, root = self._store()
        others = [f.path for f in self._listed(store, root) if f.path != piece.path]
        for path in [piece.path, *others]:
            try:
                file = store.open_input_file(path)
            except FileNotFoundError:
                continue
            if file.size() >= piece.last and _head(file, piece.head_size) == piece.head:
                return file
            file.close()
        if self.fail_on_loss:
            raise FileNotFoundError(f"{piece.path} was removed or cut off before its lines up to {piece.last} were read")
        return None

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._lines(piece)

    def _lines(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        file = self._open(piece)
        if file is None:
            return
        with file:
            # a line belongs to the piece in which it begins
            start = piece.start if piece.start == piece.first else _line_end_after(file, piece.start - 1, piece.last)
            stop = piece.stop if piece.stop == piece.last else _line_end_after(file, piece.stop - 1, piece.last)
            data = file.read_at(stop - start, start) if stop > start else b""
        lines = [line.strip() for line in data.decode("utf-8", "replace").split("\n")]
        lines = [line for line in lines if line]
        n = len(lines)
        columns = [pa.array(lines, pa.string()), pa.array([piece.name] * n, pa.string()), pa.array([piece.modified] * n, pa.timestamp("us", "UTC"))]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def tail_lines(spark: SparkSession, root: str, files: str = "*", start_at: str = "end", max_bytes_per_file: int = 1 << 30,
               chunk_bytes: int = 32 << 20, fail_on_data_loss: bool = True) -> DataFrame:
    """New lines of the files below `root` (a path or URI that driver and executors reach) as (value, source_file, modified_at).

    `files` are patterns on the path below `root`, separated by commas; let them match rotated names too. Files that are
    there when the query first starts are read from their end on, unless `start_at` is "start"; files that come later are
    read from their beginning. Lines keep the name under which their file was first seen. Blank lines are left out, and a
    line is read once its end is written. Each batch takes up to `max_bytes_per_file` of a file, dealt to tasks in pieces
    of `chunk_bytes`, small files together. If a file is gone before what it held was read, the query fails, or skips it if told so.
    """
    spark.dataSource.register(LogTail)
    return (
        spark.readStream.format("log_tail").option("files", files).option("startAt", start_at)
        .option("maxBytesPerFile", max_bytes_per_file).option("chunkBytes", chunk_bytes)
        .option("failOnDataLoss", str(fail_on_data_loss).lower()).load(root)
    )
