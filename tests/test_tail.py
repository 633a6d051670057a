"""The line reader, the tail's table of files, keyed keep-last over batches, and the merging of what it stores."""

import io
import json
import os
import random
import tracemalloc

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_units import line

from usageloom.operators.aggregates import by_day_model
from usageloom.operators.clean import clean_usage, priced
from usageloom.plans.usage import DAYS, TODAY
from usageloom.sources import lines
from usageloom.sources.usage import parse_lines, read_lines, write_logs
from usageloom.streaming import file_map, tail
from usageloom.streaming.partials import Partials

TS = "2025-06-11T14:00:00Z"


def test_lines_are_those_that_begin_in_a_stretch(monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 7)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab\n", weights=[4, 4, rng.randrange(1, 6)], k=rng.randrange(80))).encode()
        whole, at = [], 0
        for piece in text.split(b"\n"):
            whole.append((at, piece))
            at += len(piece) + 1
        if text.endswith(b"\n") or not text:
            whole.pop()
        want = [(o, x) for o, x in whole if len(x) <= 10]
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(3))})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in lines.lines_of(io.BytesIO(text), a, b, 10)]
        assert got == want
        assert lines.last_line_end(io.BytesIO(text), len(text)) == text.rfind(b"\n") + 1


class Endless(io.RawIOBase):
    """A file with one line of `size` bytes between two short ones."""

    def __init__(self, size):
        self.size, self.at = size, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        begin, self.at = self.at, min(self.at + n, self.size + 10)
        out = b"x" * (self.at - begin)
        if begin == 0:
            out = b"one\n" + out[4:]
        if begin < self.size + 5 <= self.at:
            out = out[: self.size + 4 - begin] + b"\nlast\n"[: self.at - self.size - 4 + begin]
        return out[: self.at - begin]


def test_a_long_line_takes_constant_memory():
    peaks = []
    for size in (8 << 20, 512 << 20):
        tracemalloc.start()
        assert [x for _, x in lines.lines_of(Endless(size), 0, size + 10)][0] == b"one"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 4 << 20 and peaks[1] < 1.2 * peaks[0]


def test_stretches_are_put_into_parts():
    found = lines.parts([lines.Stretch("a", 0, 25), lines.Stretch("b", 3, 6), lines.Stretch("c", 0, 0, 2), lines.Stretch("d", 0, 4)], 10)
    assert [[(s.path, s.start, s.stop) for s in p.stretches] for p in found] == [[("a", 0, 10)], [("a", 10, 20)], [("a", 20, 25), ("b", 3, 6), ("c", 0, 0), ("d", 0, 2)], [("d", 2, 4)]]
    assert lines.parts([]) == []


def test_the_line_source_equals_the_text_source(spark, sf_dir, tmp_path):
    logs = f"{tmp_path}/logs"
    write_logs(spark.read.parquet(f"{sf_dir}/events.parquet"), logs)
    (tmp_path / "logs" / "_also.txt").write_text(line(TS) + "\r\n" + "y" * (2 << 20) + "\nno end")
    (tmp_path / "logs" / ".hidden.txt").write_text(line(TS) + "\n")
    (tmp_path / "logs" / "other.json").write_text(line(TS) + "\n")
    sums = lambda r: by_day_model(priced(clean_usage(parse_lines(r), TODAY, DAYS))).collect()
    at = lines.read_lines_at(spark, [logs, logs], pattern="*.txt", part_bytes=10_000)
    assert at.rdd.getNumPartitions() > 20
    assert sums(at) == sums(read_lines(spark, [logs], pattern="*.txt"))
    odd = at.where(F.col("file").contains("_also")).orderBy("offset").collect()
    assert [(r["offset"], r["value"]) for r in odd] == [(0, line(TS)), (len(line(TS)) + 2 + (2 << 20) + 1, "no end")]
    assert lines.read_lines_at(spark, [f"{tmp_path}/none"]).count() == 0
    os.utime(tmp_path / "logs" / "_also.txt", (1e9, 1e9))
    import datetime as dt

    assert at.where(F.col("file").contains("_also")).count() == 2
    assert lines.read_lines_at(spark, [logs], dt.datetime(2020, 1, 1), "*.txt").where(F.col("file").contains("_also")).count() == 0


def total_of(spark, logs, store, **how):
    tail.tail_costs(spark, str(logs), str(store), **how)
    return tail.stored_costs(spark, str(store)).agg(F.sum(F.col("input_tokens") + F.col("output_tokens"))).first()[0] or 0


def test_chunks_of_a_message_in_two_batches_count_once(spark, tmp_path):
    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    log = logs / "a.jsonl"
    log.write_text(line(TS, tokens=(10, 0)) + "\n" + line(TS, tokens=(4, 0), key=(None, None)) + "\n")
    assert total_of(spark, logs, store) == 14
    with log.open("a") as f:
        f.write(line(TS, tokens=(30, 0)) + "\n" + line(TS, tokens=(4, 0), key=(None, None)) + "\n")
    assert total_of(spark, logs, store) == 38
    with log.open("a") as f:  # a later chunk of another model and day, and a smaller one
        f.write(line("2025-06-12T14:00:00Z", "claude-opus-4", tokens=(7, 1)) + "\n")
    assert total_of(spark, logs, store) == 16
    rows = {(str(r["day"]), r["model"]): r["input_tokens"] for r in tail.stored_costs(spark, str(store)).collect()}
    assert rows == {("2025-06-11", "claude-sonnet-4"): 8, ("2025-06-12", "claude-opus-4"): 7}


def test_a_rewrite_that_is_larger_is_seen(spark, tmp_path):
    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    log = logs / "a.jsonl"
    log.write_text(line(TS, tokens=(33, 0)) + "\n")
    assert total_of(spark, logs, store) == 33
    log.write_text("\n".join(line(TS, tokens=(i, 0), key=(str(i), "r")) for i in range(1, 10)) + "\n")
    assert total_of(spark, logs, store) == 45
    with log.open("a") as f:
        f.write(line(TS, tokens=(5, 0), key=("9", "r")) + "\n")
    assert total_of(spark, logs, store) == 41


def test_a_first_run_is_several_batches_with_small_offsets(spark, tmp_path):
    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    for i in range(60):
        # Every message has a chunk in two files' worth of batches: files are keyed apart, so both count.
        (logs / f"{i:02d}.jsonl").write_text("\n".join(line(TS, tokens=(1, 0), key=(str(j % 4), "r")) for j in range(8)) + "\n")
    size = sum(f.stat().st_size for f in logs.iterdir())
    assert total_of(spark, logs, store, batch_bytes=size // 5) == 240
    offsets = sorted((tmp_path / "store" / "progress" / "offsets").glob("[0-9]*"))
    assert len(offsets) >= 5
    assert {json.loads(o.read_text().splitlines()[-1]).keys() == {"version"} for o in offsets} == {True}
    assert total_of(spark, logs, store) == 240 and len(list((tmp_path / "store" / "progress" / "offsets").glob("[0-9]*"))) == len(offsets)


def reader_of(tmp_path, **how):
    return tail.LogTailReader(str(tmp_path / "logs"), "*.jsonl", str(tmp_path / "state"), how.get("batch_bytes", 1 << 30))


def told(reader, start, end):
    return [(os.path.basename(s.path), s.start, s.stop, s.life) for p in reader.partitions(start, end) for s in p.stretches]


def test_versions_of_the_file_map(tmp_path, monkeypatch):
    monkeypatch.setattr(file_map, "WHOLE_EVERY", 3)
    opened, whole = [], tail.last_line_end
    monkeypatch.setattr(tail, "last_line_end", lambda f, size: opened.append(size) or whole(f, size))
    (tmp_path / "logs").mkdir()
    for name in "abc":
        (tmp_path / "logs" / f"{name}.jsonl").write_text("x\n")
    reader = reader_of(tmp_path)
    none, first = reader.initialOffset(), reader.latestOffset()
    assert (none, first) == ({"version": 0}, {"version": 1}) and reader.latestOffset() == first and len(opened) == 3
    assert told(reader, none, first) == [("a.jsonl", 0, 2, 0), ("b.jsonl", 0, 2, 0), ("c.jsonl", 0, 2, 0)]
    with (tmp_path / "logs" / "a.jsonl").open("a") as f:
        f.write("yy\nz")
    again = reader_of(tmp_path)  # a restart reads the table
    second = again.latestOffset()
    assert len(opened) == 4 and told(again, first, second) == [("a.jsonl", 2, 5, 0)]
    (tmp_path / "logs" / "b.jsonl").write_text("new first bytes\n")
    (tmp_path / "logs" / "c.jsonl").unlink()
    third = again.latestOffset()
    assert told(again, second, third) == [("b.jsonl", 0, 0, 1), ("b.jsonl", 0, 16, 1)]
    assert told(again, first, third) == [("a.jsonl", 2, 5, 0), ("b.jsonl", 0, 0, 1), ("b.jsonl", 0, 16, 1)]
    again.commit(third)
    assert sorted(os.listdir(tmp_path / "state")) == ["whole-3.parquet"]
    (tmp_path / "logs" / "c.jsonl").write_text("back\n")
    fourth = again.latestOffset()
    assert told(again, third, fourth) == [("c.jsonl", 0, 0, 1), ("c.jsonl", 0, 5, 1)]
    # A new query over an old map begins with the whole of what it admitted; a version between that is gone is an error.
    assert told(reader_of(tmp_path), none, fourth)[:2] == [("a.jsonl", 0, 5, 0), ("b.jsonl", 0, 16, 1)]
    with pytest.raises(ValueError):
        told(again, first, fourth)


def test_large_logs_are_admitted_piecewise_and_in_turn(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "big.jsonl").write_text("0123456789\n" * 20)
    (tmp_path / "logs" / "small.jsonl").write_text("ab\n")
    reader = reader_of(tmp_path, batch_bytes=64)
    offsets = [reader.initialOffset()]
    while (now := reader.latestOffset()) != offsets[-1]:
        offsets.append(now)
    steps = [told(reader, a, b) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert steps[0] == [("big.jsonl", 0, 64, 0)] and steps[1][0] == ("small.jsonl", 0, 3, 0)  # the one that has waited longer
    assert all(sum(b - a for _, a, b, _ in s) <= 64 for s in steps)
    rows = [r for a, b in zip(offsets, offsets[1:], strict=False) for p in reader.partitions(a, b) for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["offset"] for r in rows if r["file"].endswith("big.jsonl")) == [11 * i for i in range(20)]


def test_files_of_a_job_that_still_writes_are_not_read(tmp_path):
    logs = tmp_path / "logs"
    ahead = logs / "half1" / "_temporary" / "0" / "task_1" / "part=0"
    ahead.mkdir(parents=True)
    (logs / "a.jsonl").write_text("x\n")
    (ahead / "b.jsonl").write_text("yy\n")
    reader = reader_of(tmp_path)
    first = reader.latestOffset()
    assert told(reader, reader.initialOffset(), first) == [("a.jsonl", 0, 2, 0)]
    ahead.rename(logs / "half1" / "part=0")
    second = reader.latestOffset()
    assert told(reader, first, second) == [("b.jsonl", 0, 3, 0)] and second == {"version": 2}


def test_logs_that_go_while_they_are_tailed(tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name in "abc":
        (logs / f"{name}.jsonl").write_text(f"{name}\n")
    whole = tail.listed

    def listed(*given):
        found = list(whole(*given))
        (logs / "a.jsonl").unlink(missing_ok=True)  # between the listing and the look into the files
        return found

    monkeypatch.setattr(tail, "listed", listed)
    reader = reader_of(tmp_path)
    first = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), first)
    (logs / "b.jsonl").unlink()  # between the version and the reading
    assert [r["value"] for p in parts for batch in reader.read(p) for r in batch.to_pylist()] == ["c"]
    second = reader.latestOffset()  # one that was told of is gone, and read from its beginning when it is back
    assert told(reader, first, second) == []
    (logs / "b.jsonl").write_text("b\n")
    third = reader.latestOffset()
    assert told(reader, second, third) == [("b.jsonl", 0, 0, 1), ("b.jsonl", 0, 2, 1)]
    logs.rename(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):  # a task that doesn't see the folder
        list(reader.read(parts[0]))


def test_partials_are_merged_behind_a_manifest(spark, tmp_path):
    schema = "k string, n long"
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n")).coalesce(1)
    store = Partials(str(tmp_path / "p"), schema, merge, every=4)
    early = None
    for i in range(23):
        batch = spark.createDataFrame([("a", 1), (f"k{i % 3}", 10)], schema).coalesce(1)
        store.put(batch, i)
        store.put(batch, i)  # a batch that runs twice
        if i == 8:
            early = store.read(spark)
        if i == 10:  # a reader of the state before the merging still ends
            assert early.agg(F.sum("n")).first()[0] == 9 * 11
        assert store.read(spark).agg(F.sum("n")).first()[0] == (i + 1) * 11
        assert len(list((tmp_path / "p").rglob("*.parquet"))) <= 2 * 4 * 2 + 2
    assert store.merged_upto() == 19 and {r["k"]: r["n"] for r in merge(store.read(spark)).collect()} == {"a": 23, "k0": 80, "k1": 80, "k2": 70}
    # Half-written things don't count.
    (tmp_path / "p" / "batch=99").mkdir()
    (tmp_path / "p" / "manifest=99.part").write_text("")
    assert store.read(spark).agg(F.sum("n")).first()[0] == 23 * 11
    assert Partials(str(tmp_path / "none"), schema, merge).read(spark).count() == 0


def test_files_of_a_table_are_read_by_as_many_tasks_as_their_bytes_need(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text("".join(f"{j:09d}\n" for j in range(1000)))
    files = spark.createDataFrame([(str(f), f.stat().st_size) for f in sorted(tmp_path.iterdir())], "path string, length long")
    rows = lines.lines_of_files(files, part_bytes=5000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["file"][-5:], r["offset"], r["value"]) for r in rows) == [(f"{i}.txt", 10 * j, f"{j:09d}") for i in range(4) for j in range(1000)]
    share = [sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}]
    assert len(share) >= 6 and max(share) < 1500


class Handle:
    """Values of state in memory, and a count of the exchanges with them."""

    def __init__(self):
        self.value, self.exchanges = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.exchanges += 1
        return self.value

    def update(self, value):
        self.exchanges += 1
        self.value = value


def test_a_groups_messages_share_one_exchange_with_the_state():
    handle, last = Handle(), tail.LastChunk()
    last.init(handle)
    rows = lambda messages, life, offset, n: [Row(file="f", group=3, message_key=m, life=life, offset=offset, day=None, model="m", input_tokens=n, output_tokens=1) for m in messages]
    told = lambda given: [(r["life"], r["input_tokens"], r["output_tokens"]) for r in last.handleInputRows(("f", 3), iter(given), None)]
    messages = [f"m{i}" for i in range(1000)]
    assert told([*rows(messages, 0, 9, 2), *rows(messages, 0, 5, 7), *rows([None, None], 0, 1, 100)]) == [(0, 2200, 1002)]
    assert handle.exchanges == 2
    # Later chunks take the earlier ones back, late ones don't count, and a new life doesn't touch the old one's sums.
    assert told([*rows(messages[:10], 0, 20, 5), *rows(messages[10:20], 0, 3, 5)]) == [(0, 30, 0)]
    assert told(rows(messages[:1], 1, 0, 4)) == [(1, 4, 1)]
    assert handle.exchanges == 6
