"""A quota window's alerts, forecasts and last good sample on a stream, with keyed state; and a sink that posts each alert once.

Of a micro-batch a window's samples are sorted in its task; how many there are is bounded at the source (maxFilesPerTrigger,
maxBytesPerTrigger). State is small: the last HISTORY samples, four values for the alerts, and the last good sample.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from usageloom.operators.series import ALERT_MINUTES, HISTORY, LEAST_SAMPLES, RECENT, SURE_SAMPLES, USED_UP
from usageloom.sources.lines import opened


def slope_of(points: Sequence[tuple[float, float]]) -> float | None:
    """The least-squares rate of (seconds, value); none without spread in time."""
    if not points:
        return None
    mx, my = (sum(c) / len(points) for c in zip(*points, strict=True))
    spread = sum((x - mx) ** 2 for x, _ in points)
    return sum((x - mx) * (y - my) for x, y in points) / spread if spread else None


def forecast_of(points: Sequence[tuple[float, float]], until_reset: float) -> tuple[float | None, str]:
    """(minutes left or none, confidence) from a window's last samples, the newest at the end."""
    recent, current = points[-RECENT:], points[-1][1]
    rate = slope_of(recent)
    if len(points) < LEAST_SAMPLES or rate is None:
        return None, "calculating"
    if rate <= 0:
        return None, "stable"
    left = (100 - min(100.0, max(0.0, current))) / rate
    if left > until_reset:
        return None, "low"
    return left / 60, "high" if len(recent) >= SURE_SAMPLES else "low"


FORECASTS = "window_id {id}, seq long, place int, alert string, minutes double, confidence string"


class Quota(StatefulProcessor):
    """For each sample its forecast (place 0, no alert), and then its alerts in order: depleted or restored (1), a threshold (2), predictive (3).

    A sample while alerts are off only joins the history: it changes no alert state.
    """

    def __init__(self, thresholds: Sequence[int]):
        self.marks = sorted(t for t in set(thresholds) if 1 <= t <= 100)

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, as each is an exchange of its own with the store of states.
        self.kept = handle.getValueState("kept", "seconds array<double>, used array<double>, previous double, fired array<int>, depleted boolean, near boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seconds, used, previous, fired, depleted, near = self.kept.get() or ([], [], None, [], False, False)
        points, fired = list(zip(seconds, used, strict=True)), set(fired)
        for r in sorted(rows, key=lambda r: (r["seconds"], r["seq"])):
            points = [*points, (r["seconds"], r["used"])][-HISTORY:]
            minutes, confidence = forecast_of(points, r["until_reset"])
            out = [(0, None)]
            if r["enabled"]:
                left = 100 - r["used"]
                if (left <= USED_UP) != depleted:
                    depleted = not depleted
                    out.append((1, "depleted" if depleted else "restored"))
                fired = {t for t in fired if left <= t}
                due = [t for t in self.marks if left <= t and t not in fired and (previous is None or previous > t)]
                if due:
                    fired |= {t for t in self.marks if t >= due[0]}
                    out.append((2, str(due[0])))
                # Armed anew once the forecast recedes; a window that is used up has had its alert.
                was_near, near = near, minutes is not None and minutes <= ALERT_MINUTES
                if near and not was_near and not depleted:
                    out.append((3, "predictive"))
                previous = left
            for place, alert in out:
                yield Row(window_id=key[0], seq=r["seq"], place=place, alert=alert, minutes=minutes, confidence=confidence)
        seconds, used = ([p[i] for p in points] for i in (0, 1))
        self.kept.update((seconds, used, previous, sorted(fired), depleted, near))

    def close(self) -> None:
        pass


def quota_alerts(samples: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Rows (window_id, seq, place, alert, minutes, confidence) of a stream (window_id, seq, seconds, used, until_reset, enabled), see Quota.

    The stream must be of a stateful_session (state.py), and start in append mode.
    """
    schema = FORECASTS.format(id=samples.schema["window_id"].dataType.simpleString())
    return samples.groupBy("window_id").transformWithState(Quota(thresholds), schema, "Append", "None")


class LastGood(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.good = handle.getValueState("good", "used double, seq long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = good = self.good.get() or (None, None)
        for r in sorted(rows, key=lambda r: (r["seconds"], r["seq"])):
            if not r["has_error"]:
                good = (r["used"], r["seq"])
            yield Row(window_id=key[0], seq=r["seq"], has_error=r["has_error"], used=good[0], good_seq=good[1])
        if good != before:
            self.good.update(good)

    def close(self) -> None:
        pass


def carried_forward(samples: DataFrame, keep_seconds: int = 7 * 86400) -> DataFrame:
    """Rows (window_id, seq, has_error, used, good_seq) of a stream (window_id, seq, seconds, used, has_error): errors keep the last good sample.

    A good sample that no other has followed for keep_seconds of processing time is forgotten. Session and mode as in quota_alerts.
    """
    schema = f"window_id {samples.schema['window_id'].dataType.simpleString()}, seq long, has_error boolean, used double, good_seq long"
    return samples.groupBy("window_id").transformWithState(LastGood(keep_seconds * 1000), schema, "Append", "ProcessingTime")


@dataclass
class Staged(WriterCommitMessage):
    name: str | None


class PostsWriter(DataSourceStreamWriter):
    """Tasks stage a batch's posts as files; the commit names them in one manifest of the batch, and only what a manifest names is posted.

    A batch that runs again finds its manifest: what it has staged anew is deleted. So is what an aborted batch has staged.
    """

    def __init__(self, outbox: str):
        self.outbox = outbox

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, path = opened(self.outbox)
        lines = [json.dumps(r.asDict(), ensure_ascii=False) for r in iterator]
        if not lines:
            return Staged(None)
        fs.create_dir(f"{path}/posts", recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with fs.open_output_stream(f"{path}/posts/{name}") as f:
            f.write(("\n".join(lines) + "\n").encode())
        return Staged(name)

    def _delete(self, messages: list[Staged | None]) -> None:
        fs, path = opened(self.outbox)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{path}/posts/{m.name}")

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        from pyarrow import fs as pafs

        fs, path = opened(self.outbox)
        name = f"{path}/manifests/{batchId}.json"
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            self._delete(messages)
            return
        fs.create_dir(f"{path}/manifests", recursive=True)
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        fs.move(f"{name}.part", name)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._delete(messages)


class AlertPosts(DataSource):
    """Sink `alert_posts`, with the option outbox, a folder of its own: rows (id, body, ...) as posts."""

    @classmethod
    def name(cls) -> str:
        return "alert_posts"

    def streamWriter(self, schema, overwrite: bool) -> PostsWriter:
        return PostsWriter(self.options["outbox"])


def posted(spark: SparkSession, outbox: str, schema: str) -> DataFrame:
    """The posts of all batches that were committed, with the batch's number; a manifest is a line, so the driver lists no posts."""
    from pyspark.sql import functions as F

    fs, path = opened(outbox)
    fs.create_dir(f"{path}/manifests", recursive=True)
    fs.create_dir(f"{path}/posts", recursive=True)
    found = spark.read.schema("value string").option("pathGlobFilter", "*.json").text(f"{outbox}/manifests").select(F.from_json("value", "array<string>").alias("names"), F.col("_metadata.file_name").alias("manifest"))
    named = found.select(F.explode("names").alias("name"), F.regexp_extract("manifest", r"^(\d+)", 1).cast("long").alias("batch"))
    posts = spark.read.schema(schema).json(f"{outbox}/posts").select("*", F.col("_metadata.file_name").alias("name"))
    return posts.join(named, "name").drop("name")
