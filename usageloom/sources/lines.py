"""Lines of files with their true byte offsets, in bounded memory; files are split, listed and reached through Arrow's file systems.

A task reads stretches of files: the lines that begin in them, to their ends. It holds a piece of CHUNK bytes, and of a line
up to the longest that counts: what is longer is passed over while it is read. So memory doesn't follow a line's length, and
time follows the bytes, whatever the lines. The batch source here and the tail of streaming/tail.py read with the same code.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one task reads, bytes that are read at once, and rows of a batch that goes to the JVM.
PART_BYTES, CHUNK, BATCH_ROWS = 64 << 20, 256 << 10, 4096
#: Fixed value: longer lines are dropped, as a cut line is no JSON.
MOST_LINE_BYTES = 1 << 20
#: Fixed value: the folder in which a Spark or Hadoop job keeps its files until it commits them, and moves them to their place.
UNCOMMITTED = "_temporary"


def opened(root: str):
    """(file system, path) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


def listed(root: str, pattern: str) -> Iterator[tuple[str, object]]:
    """(address, what its file system tells) of each file below the root whose name fits the pattern; names that begin with a dot are hidden, and what a job hasn't committed."""
    from pyarrow import fs as pafs

    root = root.rstrip("/") or "/"
    fs, path = opened(root)
    prefix = root[: len(root) - len(path)] if root.endswith(path) else ""
    todo = [path]
    while todo:
        for info in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if info.base_name.startswith("."):
                continue
            if info.type == pafs.FileType.Directory:
                if info.base_name != UNCOMMITTED:
                    todo.append(info.path)
            elif info.is_file and fnmatch.fnmatchcase(info.base_name, pattern):
                yield prefix + info.path, info


def lines_of(file, start: int, stop: int, most: int = MOST_LINE_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines of at most `most` bytes that begin in [start, stop), without their ends; to the file's end if the last has none."""
    skip = start > 0
    at = start - skip  # a line begins at start if the byte before it ends one
    file.seek(at)
    held: list[bytes] = []
    size = 0
    while at < stop and (chunk := file.read(CHUNK)):
        *ends, rest = chunk.split(b"\n")
        for piece in ends:
            size += len(piece)
            if not skip and size <= most:
                yield at, b"".join((*held, piece)) if held else piece
            at += size + 1
            held, size, skip = [], 0, False
            if at >= stop:
                return
        size += len(rest)
        if skip or size > most:
            held = []
        elif rest:
            held.append(rest)
    if at < stop and size and not skip and size <= most:
        yield at, b"".join(held)


def last_line_end(file, size: int) -> int:
    """The offset after the last line end in the first `size` bytes."""
    at = size
    while at > 0:
        low = max(0, at - CHUNK)
        file.seek(low)
        cut = file.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return 0


@dataclass
class Stretch:
    path: str
    start: int
    stop: int
    life: int = 0


@dataclass
class Part(InputPartition):
    stretches: list[Stretch]


def parts(stretches: Iterable[Stretch], size: int = PART_BYTES) -> list[Part]:
    """Stretches cut, and put together, so that tasks have about `size` bytes each."""
    found, room = [Part([])], size
    for s in stretches:
        at = s.start
        while at < s.stop or at == s.start == s.stop:
            if not room:
                found.append(Part([]))
                room = size
            end = min(s.stop, at + room)
            found[-1].stretches.append(Stretch(s.path, at, end, s.life))
            room, at = room - (end - at), end
            if s.start == s.stop:
                break
    return [p for p in found if p.stretches]


def batches(rows: Iterable[tuple], kinds: Sequence[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of BATCH_ROWS rows, or about MOST_LINE_BYTES of their last column, at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == BATCH_ROWS or size >= MOST_LINE_BYTES:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


LINE_COLUMNS = [("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())]


class LogLinesReader(DataSourceReader):
    def __init__(self, roots: list[str], pattern: str, since: float, part_bytes: int):
        self.roots, self.pattern, self.since, self.part_bytes = roots, pattern, since, part_bytes

    def partitions(self) -> list[Part]:
        sizes = {address: info.size for root in self.roots for address, info in listed(root, self.pattern) if info.mtime_ns >= self.since * 1e9}
        return parts((Stretch(address, 0, size) for address, size in sorted(sizes.items()) if size), self.part_bytes) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for s in partition.stretches:
                fs, path = opened(s.path)
                with fs.open_input_file(path) as f:
                    for offset, line in lines_of(f, s.start, s.stop):
                        yield s.path, offset, line.decode("utf-8", "replace").removesuffix("\r")

        yield from batches(rows(), LINE_COLUMNS)


class LogLines(DataSource):
    """Format `log_lines`, with the options roots (a JSON list), pattern, since (seconds, of the modification) and part_bytes: rows (file, offset, value)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> LogLinesReader:
        o = self.options
        return LogLinesReader(json.loads(o["roots"]), o.get("pattern", "*.jsonl"), float(o.get("since", 0)), int(o.get("part_bytes", PART_BYTES)))


def read_lines_at(spark: SparkSession, roots: Sequence[str], modified_since: dt.datetime | None = None, pattern: str = "*.jsonl", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (file, offset, value) as sources.usage.read_lines gives them, but with offsets in bytes; modified_since is a local time."""
    spark.dataSource.register(LogLines)
    reader = spark.read.format("log_lines").option("roots", json.dumps(list(dict.fromkeys(roots)))).option("pattern", pattern).option("part_bytes", str(part_bytes))
    if modified_since is not None:
        reader = reader.option("since", str(modified_since.timestamp()))
    return reader.load()


def lines_of_files(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (file, offset, value) of the files in a table (path, length): they are dealt to tasks in stretches, without a listing at the driver.

    The table is small, so a shuffle that may join partitions would give all files to one task: there is one for each
    part_bytes of text, and stretches are an eighth of that, so that tasks get about the same.
    """
    step = max(1, part_bytes // 8)
    tasks = max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // part_bytes))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start")
    cut = files.where("length > 0").select("path", first, "length").select("path", "start", F.least(F.col("start") + step, "length").alias("stop"))

    def read(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in given:
                for s in batch.to_pylist():
                    fs, path = opened(s["path"])
                    with fs.open_input_file(path) as f:
                        for offset, line in lines_of(f, s["start"], s["stop"]):
                            yield s["path"], offset, line.decode("utf-8", "replace").removesuffix("\r")

        yield from batches(rows(), LINE_COLUMNS)

    return cut.repartition(tasks, "path", "start").mapInArrow(read, "file string, offset long, value string")
