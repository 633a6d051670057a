"""Usage records: from JSON-lines activity logs, or from an `events` table that stands in for them.

A usage row is (file, offset, ts, day, weekday, hour, model, project, session_id, message_key, input_tokens,
output_tokens, cache_read, cache_write). ts is the local time in a stated zone; offset only orders the rows of a file.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.models import normal_model
from usageloom.functions.scalars import iso_timestamp, lenient_int, project_of, weekday
from usageloom.sources.lines import MOST_LINE_BYTES

LINE = (
    "type string, timestamp string, requestId string, sessionId string, session_id string, cwd string, "
    "message struct<id: string, model: string, usage: struct<input_tokens: double, output_tokens: double, "
    "cache_read_input_tokens: double, cache_creation_input_tokens: double>>"
)
USAGE = ["file", "offset", "ts", "day", "weekday", "hour", "model", "project", "session_id", "message_key", "input_tokens", "output_tokens", "cache_read", "cache_write"]


def log_roots(defaults: Sequence[str], env: Mapping[str, str] = os.environ, variable: str = "USAGE_LOG_DIRS", extra: str | None = None) -> list[str]:
    """The default folders, those of a comma-separated variable (with `projects` below each), and one more; each once, in order."""
    named = [p.strip() for p in env.get(variable, "").split(",") if p.strip()]
    below = [p if p.rstrip("/").split("/")[-1] == "projects" else f"{p.rstrip('/')}/projects" for p in named]
    every = [*defaults, *below, *([extra] if extra else [])]
    return list(dict.fromkeys(p.rstrip("/") or "/" for p in every))


def modified_floor(today: dt.date, window_days: int) -> dt.datetime:
    """Files that were last modified before this can hold no row of the window; a day's slack covers zones."""
    return dt.datetime.combine(today, dt.time()) - dt.timedelta(days=max(1, window_days))


def read_lines(spark: SparkSession, roots: Sequence[str], modified_since: dt.datetime | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """Rows (file, offset, value) of every file below the roots whose name fits the pattern; only files modified at or after modified_since are opened.

    Files are split freely; offset (the split's start, then a number that grows along it) keeps a file's line order.
    """
    # The reader passes over the rest of a line that is too long, without keeping it.
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mapreduce.input.linerecordreader.line.maxlength", str(MOST_LINE_BYTES + 1))
    if modified_since is not None:
        before = modified_since - dt.timedelta(seconds=1)  # the option is strict
        reader = reader.option("modifiedAfter", before.strftime("%Y-%m-%dT%H:%M:%S"))
    lines = reader.text(list(roots)).select("value", "_metadata.file_path", "_metadata.file_block_start")
    offset = F.struct(F.col("file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("file_path").alias("file"), offset.alias("offset"), "value")


def may_be_usage(value: Column) -> Column:
    """A cheap test on the raw line, before it is parsed."""
    return value.contains('"type":"assistant"') & value.contains('"usage"') & (F.octet_length(value) <= MOST_LINE_BYTES)


def local_time(instant: Column, zone: str) -> Column:
    return F.convert_timezone(None, F.lit(zone), instant.cast("timestamp_ntz"))


def parse_lines(lines: DataFrame, zone: str = "UTC", keep: Sequence[str] = ()) -> DataFrame:
    """Usage rows of (file, offset, value), and the columns of `keep`; lines that aren't usage records, or have no valid time, go."""
    # Exploded, so that the filters that follow aren't pushed below and each parse the line again.
    record = F.explode(F.array(F.from_json("value", LINE))).alias("r")
    parsed = lines.where(may_be_usage(F.col("value"))).select("file", "offset", *keep, record)
    usage, message = F.col("r.message.usage"), F.col("r.message")
    parsed = parsed.where((F.col("r.type") == "assistant") & message.model.isNotNull() & usage.isNotNull())
    parsed = parsed.withColumn("ts", local_time(iso_timestamp(F.col("r.timestamp")), zone)).where("ts is not null")
    base_name = F.regexp_extract("file", r"([^/]*?)(\.jsonl)?$", 1)
    key = F.when(message.id.isNotNull() & F.col("r.requestId").isNotNull(), F.concat_ws(":", message.id, F.col("r.requestId")))
    return parsed.select(
        "file",
        "offset",
        "ts",
        F.to_date("ts").alias("day"),
        weekday(F.col("ts")).alias("weekday"),
        F.hour("ts").alias("hour"),
        normal_model(message.model).alias("model"),
        project_of(F.col("r.cwd")).alias("project"),
        F.coalesce("r.sessionId", "r.session_id", base_name).alias("session_id"),
        key.alias("message_key"),
        lenient_int(usage.input_tokens).alias("input_tokens"),
        lenient_int(usage.output_tokens).alias("output_tokens"),
        lenient_int(usage.cache_read_input_tokens).alias("cache_read"),
        lenient_int(usage.cache_creation_input_tokens).alias("cache_write"),
        *keep,
    )


#: The raw model name that stands for an event type; other types are models without a price.
RAW_MODELS = {
    "click": "anthropic.claude-opus-4-1-20250805",
    "view": "claude-sonnet-4-5-20250929",
    "purchase": " Claude-3-5-Sonnet-20241022 ",
    "signup": "anthropic/claude-haiku-3-5",
}


def raw_model(event_type: Column) -> Column:
    named = F.coalesce(*[F.when(event_type == k, F.lit(v)) for k, v in RAW_MODELS.items()])
    return F.coalesce(named, F.concat(F.lit("event-"), event_type))


def usage_of_events(events: DataFrame) -> DataFrame:
    """Usage rows of an events table (event_id, ts, user_id, event_type, value, props)."""
    k = lenient_int(F.get_json_object("props", "$.k").try_cast("double"))
    user, hour = F.col("user_id").cast("string"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    none = F.lit(0).cast("long")
    return events.select(
        F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("file"),
        F.col("event_id").alias("offset"),
        "ts",
        F.to_date("ts").alias("day"),
        weekday(F.col("ts")).alias("weekday"),
        F.hour("ts").alias("hour"),
        normal_model(raw_model(F.col("event_type"))).alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("project"),
        F.concat(user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.when(F.col("event_id") % 10 != 0, F.concat(user, F.lit(":"), hour)).alias("message_key"),
        k.alias("input_tokens"),
        lenient_int(F.floor("value")).alias("output_tokens"),
        F.when(F.col("event_id") % 3 == 0, 10 * k).otherwise(none).alias("cache_read"),
        F.when(F.col("event_id") % 7 == 0, k).otherwise(none).alias("cache_write"),
    )


def write_logs(events: DataFrame, path: str, order: Sequence[Column | str] = ("event_id",), mode: str = "error") -> None:
    """The events as JSON-lines logs (*.txt), each in the order: what parse_lines reads back as the same usage rows."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    usage = F.struct(
        k.alias("input_tokens"),
        F.floor("value").alias("output_tokens"),
        F.when(F.col("event_id") % 3 == 0, 10 * k).alias("cache_read_input_tokens"),
        F.when(F.col("event_id") % 7 == 0, k).alias("cache_creation_input_tokens"),
    )
    project = (F.col("user_id") % 12).cast("string")
    line = F.struct(
        F.lit("assistant").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("event_id") % 10 != 0, hour).alias("requestId"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("sessionId"),
        F.concat(F.lit("/home/dev/p"), project).alias("cwd"),
        F.struct(F.col("user_id").cast("string").alias("id"), raw_model(F.col("event_type")).alias("model"), usage.alias("usage")).alias("message"),
    )
    places = [o.alias(f"place{i}") if isinstance(o, Column) else F.col(o).alias(f"place{i}") for i, o in enumerate(order)]
    rows = events.select((F.col("user_id") % 7).alias("part"), F.to_date("ts").alias("day"), *places, F.to_json(line).alias("value"))
    # A task writes a folder's lines of some days, in order; a message's lines are of one day, so they meet in one file.
    dealt = rows.repartition("part", "day").sortWithinPartitions("part", *[f"place{i}" for i in range(len(places))]).select("part", "value")
    dealt.write.mode(mode).partitionBy("part").text(path)
