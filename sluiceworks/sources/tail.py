"""A stream over text files that grow: lines appended between batches arrive, which Spark's own file source never sees.

Offsets are bytes of each file up to its last line feed, so a line that is still being written waits for its end. A batch's bytes are read by as many tasks as
there are ranges of RANGE bytes; a task begins at the first line that starts in its range. Files only grow or are new; one that is gone ends
where it was read last. Paths are those of any file system that pyarrow knows (file, hdfs, s3), seen by driver and executors alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .io import AUDIT

RANGE, BLOCK = 32 << 20, 1 << 20
LINES = "file string, at long, value string"


@dataclass
class Range(InputPartition):
    """The lines of a file that start from byte `start` on and before `end`; none of them reaches beyond `limit`."""

    file: str
    start: int
    end: int
    limit: int


def whole_lines(system: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last whole line before `size` ends, not before `known`."""
    with system.open_input_file(path) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            found = f.read_at(end - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return known


def lines_of(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, line without its end) of the lines that start in a range."""
    with system.open_input_file(part.file) as f:
        # A line that starts before the range belongs to the range before: begin behind the first line feed from start - 1 on.
        at, held = part.start, b""
        read = max(part.start - 1, 0)
        skip = part.start > 0
        while at < part.end and (read < part.limit or held):
            block = f.read_at(min(BLOCK, part.limit - read), read) if read < part.limit else b""
            read += len(block)
            held += block
            if skip:
                found = held.find(b"\n")
                if found < 0:
                    if not block:
                        return
                    held = b""
                    continue
                at, held, skip = read - len(held) + found + 1, held[found + 1 :], False
            lines = held.split(b"\n")
            for line in lines[:-1]:
                if at >= part.end:
                    return
                yield at, line
                at += len(line) + 1
            held = lines[-1]
            if not block:
                return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix, self.range = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE))
        self.known: dict[str, int] = {}

    def _files(self) -> Iterator[tuple[fs.FileSystem, fs.FileInfo]]:
        system, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        found = system.get_file_info(path)
        every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
        return ((system, x) for x in sorted(every, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith(self.suffix))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for system, info in self._files():
            self.known[info.path] = whole_lines(system, info.path, info.size, min(self.known.get(info.path, 0), info.size))
        return {path: end for path, end in self.known.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**self.known, **{p: max(n, self.known.get(p, 0)) for p, n in end.items()}}
        parts = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            parts += [Range(path, a, min(a + self.range, last), last) for a in range(first, last, self.range)]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        rows, size = [], 0
        for at, line in lines_of(system, partition):
            rows.append((partition.file, at, line.rstrip(b"\r").decode(errors="replace")))
            size += len(line)
            if size > BLOCK:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("growing_lines").load(path); options: suffix of file names, rangebytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: object) -> TailReader:  # noqa: N802
        return TailReader(dict(self.options))


def growing_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """A stream of (file, at, value): the lines of a file, or of a folder's files, as they are appended."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("rangebytes", str(range_bytes)).load(path)


def audit_tail(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Audit rows of a growing log of JSON lines; lines that are not JSON are dropped."""
    parsed = growing_lines(spark, path, suffix).filter(F.trim("value") != "").select(F.from_json("value", AUDIT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter("r._corrupt IS NULL").select("r.*").drop("_corrupt")
