"""Queries that write the events as JSON-lines logs first, then read those: whole, or as a stream of what is new."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.formatting import alert_post
from usageloom.operators import aggregates as agg
from usageloom.operators.changed_files import changed_result
from usageloom.operators.clean import clean_usage, priced
from usageloom.operators import dashboard as dash
from usageloom.operators.result_cache import cached_result, kept_catalog
from usageloom.operators.series import local_seconds
from usageloom.plans.fixtures import ORACLE as PARSED
from usageloom.plans.fixtures import price_catalog
from usageloom.plans.series import ORACLE as SERIES_ORACLE
from usageloom.plans.series import RUNNING, SAMPLES, samples
from usageloom.plans.usage import BY_DAY, COST, DAYS, TODAY, Query, _total, load, rows, usage_sql
from usageloom.plans.usage import ORACLE as USAGE_ORACLE
from usageloom.sources.folders import scratch
from usageloom.sources.lines import listed, opened, read_lines_at
from usageloom.sources.usage import log_roots, modified_floor, parse_lines, read_lines, write_logs
from usageloom.streaming.alerts import alerts
from usageloom.streaming.quota import AlertPosts, carried_forward, posted, quota_alerts
from usageloom.streaming.state import stateful_session
from usageloom.streaming.tail import stored_costs, tail_costs

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _logs(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "logs")
    write_logs(load(spark, sf_dir, "events"), path)
    return path


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day and model roll-up, from log files."""
    usage = parse_lines(read_lines(spark, [_logs(spark, sf_dir)], modified_floor(TODAY, DAYS), "*.txt"))
    return agg.by_day_model(priced(clean_usage(usage, TODAY, DAYS)))


QUERIES["log_scan"] = log_scan
ORACLE["log_scan"] = f"WITH {usage_sql()}, {BY_DAY} SELECT * FROM bdm"


def _never() -> DataFrame:
    raise AssertionError("the stored result is there")


def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up from log files, stored by period and listing; the second time it is only read."""
    logs, store = _logs(spark, sf_dir), scratch(spark, "results")
    whole = lambda: agg.by_day_model(priced(clean_usage(parse_lines(read_lines(spark, [logs], pattern="*.txt")), TODAY, DAYS)))
    cached_result(spark, store, f"{DAYS}d", [logs], whole, "*.txt")
    return cached_result(spark, store, f"{DAYS}d", [logs], _never, "*.txt")


QUERIES["cached_scan"] = cached_scan
ORACLE["cached_scan"] = ORACLE["log_scan"]


def changed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up over two listings: the second run reads only the logs that came, or changed, since the first."""
    events, logs, store = load(spark, sf_dir, "events"), scratch(spark, "logs"), scratch(spark, "changed")
    usage = lambda lines: priced(clean_usage(parse_lines(lines), TODAY, DAYS))
    half = events.where("user_id % 7 < 4")
    write_logs(half, f"{logs}/half")
    # A log that is rewritten in between: at first it holds other events.
    write_logs(events.where("user_id % 7 = 5"), f"{logs}/rest")
    changed_result(spark, store, [logs], usage, "*.txt")[0].count()
    write_logs(events.where("user_id % 7 >= 4"), f"{logs}/rest", mode="overwrite")
    found, changed = changed_result(spark, store, [logs], usage, "*.txt")
    if changed.where(F.col("path").contains("/half/")).count():
        raise AssertionError("logs that haven't changed were read again")
    return found


QUERIES["changed_scan"] = changed_scan
ORACLE["changed_scan"] = ORACLE["log_scan"]


def roots_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in two folders, one of which is named twice: each counts once."""
    events, named = load(spark, sf_dir, "events"), [scratch(spark, "roots"), scratch(spark, "roots")]
    for i, root in enumerate(named):
        write_logs(events.where(F.col("user_id") % 7 % 2 == i), f"{root}/projects")
    roots = log_roots([f"{named[0]}/projects"], {"LOGS": f"{named[1]}, {named[0]}/projects"}, "LOGS", extra=f"{named[1]}/projects/")
    return agg.by_project(priced(clean_usage(parse_lines(read_lines(spark, roots, pattern="*.txt")), TODAY, DAYS)))


QUERIES["roots_scan"] = roots_scan
ORACLE["roots_scan"] = f"WITH {usage_sql()} SELECT project, {COST} AS cost, {_total('volume')} AS tokens FROM rows GROUP BY project"


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of a line: its own, under either name, or else its file's."""
    e = load(spark, sf_dir, "events")
    name = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    line = F.struct(
        F.lit("assistant").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, name).alias("sessionId"), F.when(F.col("event_id") % 2 == 0, F.concat(name, F.lit("x"))).alias("session_id"),
        F.struct(F.lit("m").alias("model"), F.struct(F.col("event_id").alias("input_tokens")).alias("usage")).alias("message"),
    )
    file = F.concat(F.lit("/logs/p.1/f"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".jsonl").otherwise(".txt"))
    lines = e.select(file.alias("file"), F.col("event_id").alias("offset"), F.to_json(line).alias("value"))
    return parse_lines(lines).select(F.col("offset").alias("event_id"), "session_id", "input_tokens")


QUERIES["session_names"] = session_names
ORACLE["session_names"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 's' || event_id WHEN event_id % 2 = 0 THEN 's' || event_id || 'x' ELSE 'f' || user_id || CASE WHEN user_id % 2 = 0 THEN '' ELSE '.txt' END END AS session_id,
  event_id AS input_tokens FROM events"""


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export, written as one file under its name and read again."""
    path = f"{scratch(spark, 'export')}/{dash.export_name(DAYS, TODAY)}"
    dash.write_csv(dash.daily_axis(agg.by_day_model(rows(spark, sf_dir)), TODAY, DAYS), path)
    found = spark.read.option("header", "true").schema("date string, cost_usd string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long").csv(path)
    return found.withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))


QUERIES["csv_file"] = csv_file
ORACLE["csv_file"] = f"SELECT *, 'claude-usage-{DAYS}d-{TODAY}.csv' AS file FROM ({USAGE_ORACLE['csv_rows']})"


def catalog_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of prices that is fetched once, kept for a day, and outlives failures after that."""
    store, start = scratch(spark, "catalog"), dt.datetime(2024, 1, 30)

    def broken() -> DataFrame:
        raise OSError("no answer")

    for hours, fetch in ((0, lambda: price_catalog(spark, sf_dir)), (23, _never), (25, broken)):
        found = kept_catalog(spark, store, fetch, start + dt.timedelta(hours=hours))
    return found


QUERIES["catalog_store"] = catalog_store
ORACLE["catalog_store"] = PARSED["price_catalog"]


TAILED = f"SELECT day, model, {_total('input_tokens')} AS input_tokens, {_total('output_tokens')} AS output_tokens, {COST} AS cost FROM rows GROUP BY day, model"


def _bytes(logs: str) -> int:
    return sum(info.size for _, info in listed(logs, "*.txt"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of a stream over the log files, in some batches, added up."""
    logs, store = _logs(spark, sf_dir), scratch(spark, "costs")
    tail_costs(spark, logs, store, suffix=".txt", batch_bytes=_bytes(logs) // 3 + 1)
    return stored_costs(spark, store)


QUERIES["log_tail"] = log_tail
ORACLE["log_tail"] = f"WITH {usage_sql(cached_too=False)} {TAILED}"


def log_tail_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a message's chunks come in different batches: each log holds its even events first, and a batch some of it."""
    logs, store = scratch(spark, "logs"), scratch(spark, "costs")
    write_logs(load(spark, sf_dir, "events"), logs, [F.col("event_id") % 2, "event_id"])
    tail_costs(spark, logs, store, suffix=".txt", batch_bytes=_bytes(logs) // 5 + 1)
    return stored_costs(spark, store)


QUERIES["log_tail_chunks"] = log_tail_chunks
ORACLE["log_tail_chunks"] = ORACLE["log_tail"].replace("ORDER BY event_id DESC", "ORDER BY event_id % 2 DESC, event_id DESC")


def log_tail_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail at an interval: one half of the logs is there when it begins, the other comes while it goes on."""
    logs, store = scratch(spark, "logs"), scratch(spark, "costs")
    events = load(spark, sf_dir, "events")
    half = lambda i: write_logs(events.where(F.col("user_id") % 7 % 2 == i), f"{logs}/half{i}")
    half(0)
    query = tail_costs(spark, logs, store, suffix=".txt", every_seconds=1)
    try:
        query.processAllAvailable()
        half(1)
        query.processAllAvailable()
    finally:
        query.stop()
    return stored_costs(spark, store)


QUERIES["log_tail_interval"] = log_tail_interval
ORACLE["log_tail_interval"] = ORACLE["log_tail"]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up from log files that are read in small stretches, their lines told by offsets in bytes."""
    usage = parse_lines(read_lines_at(spark, [_logs(spark, sf_dir)], modified_floor(TODAY, DAYS), "*.txt", part_bytes=1 << 20))
    return agg.by_day_model(priced(clean_usage(usage, TODAY, DAYS)))


QUERIES["log_lines"] = log_lines
ORACLE["log_lines"] = ORACLE["log_scan"]


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that leaves out the logs that were last modified before the window, without opening them: those of some users."""
    logs = scratch(spark, "logs")
    write_logs(load(spark, sf_dir, "events"), logs)
    old = (dt.datetime.combine(TODAY, dt.time()) - dt.timedelta(days=200)).timestamp()
    for address, _ in listed(logs, "*.txt"):
        if "/part=0/" in address or "/part=1/" in address:
            os.utime(opened(address)[1], (old, old))
    found = parse_lines(read_lines(spark, [logs], modified_floor(TODAY, DAYS), "*.txt"))
    return agg.by_project(priced(clean_usage(found, TODAY, DAYS)))


QUERIES["pruned_scan"] = pruned_scan
ORACLE["pruned_scan"] = f"WITH {usage_sql()} SELECT project, {COST} AS cost, {_total('volume')} AS tokens FROM rows WHERE file NOT IN ('f0', 'f1') GROUP BY project"


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream over the events, as a batch table."""
    source, out = scratch(spark, "samples"), scratch(spark, "alerts")
    events = load(spark, sf_dir, "events")
    used = F.least(F.lit(100.0), F.col("value"))
    sample = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("window_id"), F.col("event_id").alias("seq"), used.alias("utilization"), F.lit(True).alias("enabled"))
    sample.write.parquet(source)
    stream = spark.readStream.schema(sample.schema).parquet(source)
    query = alerts(stream, [50, 20]).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "alerts-progress"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_id string, seq long, alert string").parquet(out)


QUERIES["stream_alerts"] = stream_alerts
ORACLE["stream_alerts"] = """WITH lagged AS (SELECT 'u' || user_id AS window_id, event_id AS seq, 100 - least(100.0, value) AS remaining,
    lag(100 - least(100.0, value)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
  SELECT window_id, seq, CASE WHEN remaining <= 20 AND (previous IS NULL OR previous > 20) THEN '20' ELSE '50' END AS alert FROM lagged
    WHERE (remaining <= 20 AND (previous IS NULL OR previous > 20)) OR (remaining <= 50 AND (previous IS NULL OR previous > 50))
  UNION ALL SELECT window_id, seq, CASE WHEN remaining <= 0.0001 THEN 'depleted' ELSE 'restored' END FROM lagged WHERE (remaining <= 0.0001) <> coalesce(previous <= 0.0001, false)"""


def _streamed(make: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """All that a stream over the sample series emits, as a table, a folder for each batch.

    The samples come by thirds of the time, one after the other: each is written by all tasks, and then a batch of its own, so
    that each batch holds later samples than the one before.
    """
    source, out, progress, session = scratch(spark, "samples"), scratch(spark, label), scratch(spark, f"{label}-progress"), stateful_session(spark)
    rows = samples(spark, sf_dir).select(
        F.col("user_id").alias("window_id"), F.col("event_id").alias("seq"), local_seconds(F.col("ts")).alias("seconds"), "used", "until_reset", F.lit(True).alias("enabled"), (F.col("event_type") == "error").alias("has_error"),
    )
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    low, high = rows.agg(F.min("seconds"), F.max("seconds")).first()
    for i in range(3):
        third = F.floor((F.col("seconds") - F.lit(low)) * 3 / (F.lit(high) - F.lit(low) + 1.0)) == i
        rows.where(third).write.mode("append").parquet(source)
        found = make(session.readStream.schema(rows.schema).parquet(source))
        found.writeStream.foreachBatch(put).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).drop("batch")


def _quota(stream: DataFrame) -> DataFrame:
    return quota_alerts(stream, [50, 20])


def stream_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's forecast, from a stream."""
    found = _streamed(_quota, spark, sf_dir, "forecasts").where("place = 0")
    return found.select(F.col("window_id").alias("user_id"), F.col("seq").alias("event_id"), F.round("minutes", 6).alias("minutes"), "confidence")


QUERIES["stream_forecasts"] = stream_forecasts
ORACLE["stream_forecasts"] = f"WITH {SAMPLES}, {RUNNING} SELECT user_id, event_id, minutes, confidence FROM told"


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of a stream, each tick's in order: depleted or restored, a threshold, predictive."""
    found = _streamed(_quota, spark, sf_dir, "quota").where("place > 0")
    return found.select(F.col("window_id").alias("user_id"), F.col("seq").alias("event_id"), "place", "alert")


QUERIES["stream_quota"] = stream_quota
ORACLE["stream_quota"] = f"""WITH {SAMPLES}, {RUNNING}, ticks AS (
    SELECT *, 100 - used AS remaining, lag(100 - used) OVER w AS previous, coalesce(minutes <= 30, false) AS near, lag(coalesce(minutes <= 30, false), 1, false) OVER w AS was_near
    FROM told WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, 1 AS place, CASE WHEN remaining <= 0.0001 THEN 'depleted' ELSE 'restored' END AS alert FROM ticks WHERE (remaining <= 0.0001) <> coalesce(previous <= 0.0001, false)
  UNION ALL SELECT user_id, event_id, 2, CASE WHEN remaining <= 20 AND (previous IS NULL OR previous > 20) THEN '20' ELSE '50' END FROM ticks
    WHERE (remaining <= 20 AND (previous IS NULL OR previous > 20)) OR (remaining <= 50 AND (previous IS NULL OR previous > 50))
  UNION ALL SELECT user_id, event_id, 3, 'predictive' FROM ticks WHERE near AND NOT was_near AND remaining > 0.0001"""


def stream_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors keep the last good sample, on a stream."""
    found = _streamed(carried_forward, spark, sf_dir, "carried")
    return found.select(F.col("window_id").alias("user_id"), F.col("seq").alias("event_id"), "has_error", "used", F.col("good_seq").alias("good_event"))


QUERIES["stream_carry_forward"] = stream_carry_forward
ORACLE["stream_carry_forward"] = SERIES_ORACLE["carry_forward"]


def posted_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of a stream, posted to an outbox, each once."""
    found = _streamed(_quota, spark, sf_dir, "quota").where("place in (1, 2)")
    told = scratch(spark, "told-alerts")
    found.select(alert_post(F.col("window_id").cast("string"), F.col("alert"), F.lit(0.0)).id.alias("id"), "seq").repartition(4).write.parquet(told)
    spark.dataSource.register(AlertPosts)
    outbox = scratch(spark, "outbox")
    stream = spark.readStream.schema("id string, seq long").option("maxFilesPerTrigger", 2).parquet(told)
    query = stream.writeStream.format("alert_posts").option("outbox", outbox).option("checkpointLocation", scratch(spark, "posts-progress"))
    query.trigger(availableNow=True).start().awaitTermination()
    return posted(spark, outbox, "id string, seq long").drop("batch")


QUERIES["posted_alerts"] = posted_alerts
ORACLE["posted_alerts"] = f"""SELECT CASE WHEN place = 1 THEN alert || '-' || user_id ELSE 'threshold-' || user_id || '-' || alert END AS id, event_id AS seq FROM ({ORACLE["stream_quota"]}) WHERE place < 3"""
