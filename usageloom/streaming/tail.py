"""Incremental reading of append-only JSON-lines logs: a stream source that keeps an offset for each file, and costs with keyed state.

The source's offset is the version of a table of files (file_map.py). A new version admits stretches of up to batch_bytes, of
the files that have waited longest first, so a first run over many logs is several batches. Stretches end at the last line end
at most, so a half-written line waits for its rest. A file whose size and time haven't changed isn't opened unless some of it waits. A
file that has shrunk, that was gone, or whose first HEAD bytes have changed is read anew: each such beginning gets another
number, with which its rows are marked, so that what was stored of the beginnings before is replaced, even where the new
file has no whole line yet. A rewrite that keeps those bytes, and isn't smaller, is taken for growth. What a Spark job is still
writing below the folder isn't listed before it is committed: its files would move while they are read, or count twice. A file that is gone
between the listing and the reading has no lines any more, which doesn't end the stream.

A message's chunks may come in several batches. Keyed state holds the last chunk that counted, by file and message; a later one
takes the other's tokens back and adds its own, so the stored sums are those of a single scan. A file's messages are dealt to
GROUPS by a hash, and a group's last chunks are one value of state: a call and two exchanges with the state for each group that
a batch touches, not for each message. A line that comes rewrites its group's share of its file's messages.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from usageloom.operators.aggregates import cost_rollup, total, total_cost
from usageloom.operators.clean import has_tokens, priced
from usageloom.sources.lines import Part, batches, last_line_end, lines_of, listed, opened, parts
from usageloom.sources.usage import parse_lines
from usageloom.streaming.file_map import FileMap, Known
from usageloom.streaming.partials import Partials
from usageloom.streaming.state import stateful_session

#: Bytes that a batch admits, and the first bytes of a file by which a rewrite is told.
BATCH_BYTES, HEAD = 4 << 30, 4096
#: Groups that one file's messages are dealt to, and its rows without a message key, which need no state. Fixed as long as a store is used.
GROUPS = 256
#: The seconds between two readings that are offered; 0 is by hand.
INTERVALS = [0, 60, 120, 300, 900, 1800]
#: Stands, at the offset -1, for the beginning of a file: a usage line without tokens.
MARK = '{"type":"assistant","timestamp":"1970-01-01T00:00:00Z","message":{"model":"","usage":{}}}'
LINES = [("file", pa.string()), ("offset", pa.int64()), ("life", pa.int32()), ("value", pa.string())]


def _head(file, size: int) -> bytes:
    file.seek(0)
    return hashlib.blake2b(file.read(size), digest_size=16).digest()


class LogTailReader(DataSourceStreamReader):
    def __init__(self, root: str, pattern: str, state: str, batch_bytes: int):
        self.root, self.pattern, self.batch_bytes, self.map = root, pattern, batch_bytes, FileMap(state)
        self.version, self.known = self.map.load()

    def initialOffset(self) -> dict:
        return {"version": 0}

    def _looked_at(self, fs, path: str, address: str, info, before: Known | None) -> Known:
        """The file's new state, with nothing of it admitted yet."""
        with fs.open_input_file(path) as f:
            anew = before is not None and (before.mtime < 0 or info.size < before.size or _head(f, before.head_size) != before.head)
            at, life = (0, before.life + 1 if before else 0) if before is None or anew else (before.done, before.life)
            head_size = min(info.size, HEAD)
            return Known(address, at, at, last_line_end(f, info.size), info.size, info.mtime_ns, life, anew, head_size, _head(f, head_size), self.version + 1)

    def latestOffset(self, *_: object) -> dict:
        """A new version, if a file has changed or waits."""
        there = dict(listed(self.root, self.pattern))
        waiting = []
        for address, info in there.items():
            k = self.known.get(address)
            if k is None or (info.size, info.mtime_ns) != (k.size, k.mtime) or k.done < k.line_end:
                waiting.append((k.version if k else 0, address))
        changed, room = [], self.batch_bytes
        for _, address in sorted(waiting):
            if room <= 0:
                break
            info = there[address]
            fs, path = opened(address)
            try:
                found = self._looked_at(fs, path, address, info, self.known.get(address))
            except FileNotFoundError:
                del there[address]  # gone since it was listed
                continue
            found.done = max(found.first, min(found.line_end, found.first + room))
            room -= found.done - found.first
            changed.append(found)
        for address, k in self.known.items():
            if address not in there and k.mtime >= 0:
                changed.append(Known(address, 0, 0, 0, 0, -1, k.life, False, 0, b"", self.version + 1))
        if changed:
            self.version += 1
            self.known.update((k.path, k) for k in changed)
            self.map.add(self.version, changed, self.known)
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(self.map.stretches(start["version"], end["version"]))

    def commit(self, end: dict) -> None:
        self.map.forget(end["version"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        def rows() -> Iterator[tuple]:
            for s in partition.stretches:
                if s.start == s.stop:
                    yield s.path, -1, s.life, MARK
                    continue
                fs, path = opened(s.path)
                try:
                    f = fs.open_input_file(path)
                except FileNotFoundError:
                    # Gone since it was admitted; but a task that doesn't see the logs' folder at all must not go on without them.
                    if fs.get_file_info(opened(self.root)[1]).type == pafs.FileType.NotFound:
                        raise
                    continue
                with f:
                    for offset, line in lines_of(f, s.start, s.stop):
                        if line.strip():
                            yield s.path, offset, s.life, line.decode("utf-8", "replace").removesuffix("\r")

        yield from batches(rows(), LINES)


class LogTail(DataSource):
    """Format `log_tail`, with the options path, state (a folder of its own for the table of files), pattern (*.jsonl) and batch_bytes: rows (file, offset, life, value)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, life int, value string"

    def streamReader(self, schema) -> LogTailReader:
        o = self.options
        return LogTailReader(o["path"], o.get("pattern", "*.jsonl"), o["state"], int(o.get("batch_bytes", BATCH_BYTES)))


#: What is emitted for each change of what counts.
CHANGES = "file string, life int, day date, model string, input_tokens long, output_tokens long"


class LastChunk(StatefulProcessor):
    """Emits, as sums, the differences between messages' last chunks and those that counted before; rows without a key all count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Of each message (life, offset, day, model, input_tokens, output_tokens).
        self.last = handle.getValueState("last", "chunks binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        sums: dict[tuple, list[int]] = {}

        def count(chunk: tuple, sign: int = 1) -> None:
            life, _, day, model, put_in, out = chunk
            found = sums.setdefault((life, day, model), [0, 0])
            found[0] += sign * put_in
            found[1] += sign * out

        newest: dict[str, tuple] = {}
        for message, *chunk in (r[2:] for r in rows):
            if message is None:
                count(chunk)
            elif message not in newest or newest[message][:2] < tuple(chunk[:2]):
                newest[message] = tuple(chunk)
        if newest:
            state = self.last.get()
            last = pickle.loads(state[0]) if state is not None else {}
            for message, chunk in newest.items():
                before = last.get(message)
                if before is not None:
                    if before[:2] >= chunk[:2]:
                        continue
                    # The sums of earlier beginnings of the file don't count anyway.
                    if before[0] == chunk[0]:
                        count(before, -1)
                count(chunk)
                last[message] = chunk
            self.last.update((pickle.dumps(last, pickle.HIGHEST_PROTOCOL),))
        for (life, day, model), (put_in, out) in sums.items():
            yield Row(file=key[0], life=life, day=day, model=model, input_tokens=put_in, output_tokens=out)

    def close(self) -> None:
        pass


def changes(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """CHANGES of a stream of lines; marks come with a null day."""
    usage = parse_lines(lines, zone, keep=["life"]).where(has_tokens("input_tokens", "output_tokens") | (F.col("offset") < 0))
    group = F.pmod(F.when(F.col("message_key").isNull(), F.xxhash64("offset")).otherwise(F.xxhash64("message_key")), F.lit(GROUPS)).alias("group")
    day = F.when(F.col("offset") >= 0, F.col("day")).alias("day")
    keyed = usage.select("file", group, "message_key", "life", "offset", day, "model", "input_tokens", "output_tokens")
    return keyed.groupBy("file", "group").transformWithState(LastChunk(), CHANGES, "Update", "None")


PARTIALS = "file string, life int, day date, model string, input_tokens long, output_tokens long, cost double"


def _merged(partials: DataFrame) -> DataFrame:
    """Sums by file, day and model of each file's last beginning, and a row with a null day that tells which that is."""
    last = partials.groupBy("file").agg(F.max("life").alias("life"))
    kept = partials.join(last, ["file", "life"])
    return kept.groupBy("file", "life", "day", "model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total_cost().alias("cost"))


def _store(store: str) -> Partials:
    return Partials(f"{store}/partials", PARTIALS, _merged)


def tail_costs(spark: SparkSession, logs: str, store: str, zone: str = "UTC", suffix: str = ".jsonl", every_seconds: int = 0, batch_bytes: int = BATCH_BYTES) -> StreamingQuery:
    """Read what the logs have gained, once or at an interval, and store the sums of it: one folder a batch, so that a batch that runs twice counts once.

    every_seconds of 0 reads what is there, in batches of batch_bytes, and ends; with one of INTERVALS, or any other, the query
    goes on. Neither windows nor present-day prices are baked in beyond the batch's own: partials keep file, day and model.
    """
    session = stateful_session(spark)
    session.dataSource.register(LogTail)
    source = session.readStream.format("log_tail").option("path", logs).option("state", f"{store}/files").option("pattern", f"*{suffix}")
    lines = source.option("batch_bytes", str(batch_bytes)).load()
    stored = _store(store)

    def put(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("file", "life", "day", "model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"))
        tokens = sums.withColumns({"cache_read": F.lit(0).cast("long"), "cache_write": F.lit(0).cast("long")})
        stored.put(priced(tokens).select("file", "life", "day", "model", "input_tokens", "output_tokens", "cost"), batch_id)

    writer = changes(lines, zone).writeStream.foreachBatch(put).option("checkpointLocation", f"{store}/progress").outputMode("update")
    query = writer.trigger(processingTime=f"{every_seconds} seconds").start()
    if not every_seconds:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def stored_costs(spark: SparkSession, store: str) -> DataFrame:
    """(day, model) sums of what tail_costs has stored; of a file that was begun anew only what came since."""
    return cost_rollup(_merged(_store(store).read(spark)).where("day is not null")).where("input_tokens <> 0 or output_tokens <> 0")
