"""A streaming source over growing log files whose offset is a number of bytes for each file.

A step reads the bytes between two offsets and no others, so its work follows what was appended.  An offset ends behind a line
end, but for files that are followed by a later one in their folder: these are read to their end.  Files of a folder count
in the order of dates in their names, others behind them by modification time; one without a line end holds back those
behind it.  File systems are those of pyarrow (local, object stores, HDFS).
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, folder string, file string, rank bigint, at bigint, ends bigint, line binary"
BLOCK, ROWS = 1 << 16, 2000
_DATE = re.compile(r"(\d{4})_(\d{2})_(\d{2})")
_COPY = re.compile(r" ?\(\d+\)\.[^.]*$")
_LINES = pa.schema([("path", pa.string()), ("folder", pa.string()), ("file", pa.string()), ("rank", pa.int64()), ("at", pa.int64()), ("ends", pa.int64()), ("line", pa.binary())])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingFiles)


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("root", uri).option("pattern", "*.csv").load()``: a row a line, with the
    byte it begins at and the one behind its end."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options["root"], self.options.get("pattern", "*"))


class Range(InputPartition):
    def __init__(self, path: str, folder: str, file: str, rank: int, start: int, end: int):
        self.path, self.folder, self.file, self.rank, self.start, self.end = path, folder, file, rank, start, end


def complete_end(file: pa.NativeFile, size: int) -> int:
    """The place behind the last line end, found from the end backwards."""
    while size > 0:
        start = max(0, size - BLOCK)
        file.seek(start)
        at = file.read(size - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        size = start
    return 0


class Reader(DataSourceStreamReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def _listed(self) -> dict[str, list[fs.FileInfo]]:
        """The files of each folder in order."""
        system, root = fs.FileSystem.from_uri(self.root)
        like = re.compile("(?i)" + ".*".join(map(re.escape, self.pattern.split("*"))))
        folders = defaultdict(list)
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and like.fullmatch(info.base_name) and not _COPY.search(info.base_name):
                folders[info.path.rpartition("/")[0]].append(info)

        def order(info: fs.FileInfo) -> tuple:
            dated = _DATE.search(info.base_name)
            return (0, dated[0], "", info.path) if dated else (1, "", str(info.mtime_ns or 0).zfill(20), info.path)

        return {folder: sorted(files, key=order) for folder, files in sorted(folders.items())}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = fs.FileSystem.from_uri(self.root)
        ends: dict[str, list[int]] = {}
        for files in self._listed().values():
            for rank, info in enumerate(files):
                with system.open_input_file(info.path) as file:
                    complete = complete_end(file, info.size)
                if not complete:
                    break
                ends[info.path] = [rank, complete if info is files[-1] else info.size]
        return {"files": json.dumps(ends)}  # values of an offset are plain

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (rank, upto) in after.items():
            done = before.get(path, [0, 0])[1]
            if upto > done:
                folder, _, name = path.rpartition("/")
                out.append(Range(path, folder, name, rank, done, upto))
        return out or [Range("", "", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.start)
            at, rest, rows = partition.start, b"", []
            left = partition.end - partition.start
            while left > 0:
                got = file.read(min(BLOCK, left))
                if not got:
                    break
                left -= len(got)
                *lines, rest = (rest + got).split(b"\n")
                if not left and rest:
                    lines, rest = [*lines, rest], b""
                for line in lines:
                    ends = min(at + len(line) + 1, partition.end)
                    rows.append((partition.path, partition.folder, partition.file, partition.rank, at, ends, line.removesuffix(b"\r")))
                    at = ends
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)

    def commit(self, end: dict) -> None:
        pass
