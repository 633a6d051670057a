"""First-level roll-ups of priced usage rows. Sums are partial before each shuffle; results are ordered with full tie-breaks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.operators.clean import TOKENS

#: Costs are rounded so that the order of summing doesn't show.
DIGITS = 9


def total_cost(cost: Column | str = "cost") -> Column:
    return F.round(F.coalesce(F.sum(cost), F.lit(0.0)), DIGITS)


def total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def token_sums() -> list[Column]:
    return [total(c).alias(c) for c in TOKENS]


def cost_partials(rows: DataFrame) -> DataFrame:
    """(file, day, model) sums: what an incremental run stores, replaces by file, and adds up at reading."""
    return rows.groupBy("file", "day", "model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total_cost().alias("cost"))


def cost_rollup(partials: DataFrame) -> DataFrame:
    return partials.groupBy("day", "model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total_cost().alias("cost"))


def by_day_model(rows: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Sums by day and model; with now also `month_cost`, the part of the cost that is of now's month and not after now."""
    month = [] if now is None else [total_cost(F.when(_of_month(now), F.col("cost"))).alias("month_cost")]
    found = rows.groupBy("day", "model").agg(*token_sums(), total_cost().alias("cost"), *month)
    return found.orderBy(F.desc("cost"), F.desc("day"), "model")


def cost_summary(rows: DataFrame, today: dt.date) -> DataFrame:
    """One row: cost and tokens (input and output) of today and of the window."""
    now, tokens = F.col("day") == F.lit(today), F.col("input_tokens") + F.col("output_tokens")
    return rows.agg(
        total_cost(F.when(now, F.col("cost"))).alias("today_cost"),
        total_cost().alias("window_cost"),
        total(F.when(now, tokens)).alias("today_tokens"),
        total(tokens).alias("window_tokens"),
    )


def by_project(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(total_cost().alias("cost"), total("volume").alias("tokens")).orderBy(F.desc("cost"), "project")


def heatmap(rows: DataFrame) -> DataFrame:
    """Tokens of each weekday and hour, all 168 cells."""
    return cells_of(rows.groupBy("weekday", "hour").agg(total("volume").alias("tokens")))


def cells_of(sums: DataFrame) -> DataFrame:
    """The 168 cells of sums (weekday, hour, tokens)."""
    cells = sums.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return cells.join(sums, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).orderBy("weekday", "hour")


def sessions(rows: DataFrame) -> DataFrame:
    """A row for each session: its start, the project of its first row, tokens, cost, and the model that cost most (ties: the lesser name).

    Summed by session and model first, so that no session's rows are gathered.
    """
    first = F.min_by("project", F.struct("ts", "offset"))
    parts = rows.groupBy("session_id", "model").agg(
        F.min(F.struct("ts", "offset")).alias("start"), first.alias("project"), total("volume").alias("tokens"), total_cost().alias("cost")
    )
    return sessions_of(parts)


def sessions_of(parts: DataFrame) -> DataFrame:
    """Sessions of their sums by model: rows (session_id, model, start, project, tokens, cost)."""
    # Of models with equal costs the lesser name: the last by (cost, reversed order) is the first by (-cost, name).
    return parts.groupBy("session_id").agg(
        F.min("start.ts").alias("started"),
        F.min_by("project", "start").alias("project"),
        F.min_by("model", F.struct(-F.col("cost"), F.col("model"))).alias("dominant_model"),
        total("tokens").alias("tokens"),
        total_cost().alias("cost"),
    )


def top_sessions(rows: DataFrame, n: int = 10) -> DataFrame:
    return sessions(rows).orderBy(F.desc("cost"), F.desc("started"), "session_id").limit(n)


def _of_month(now: dt.datetime) -> Column:
    start = now.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    return F.col("ts").between(F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(now)).cast("timestamp_ntz"))


def month_to_date(rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Cost from the month's first instant up to now, of the rows given: those of a window, or of month_window for the whole month."""
    return rows.agg(total_cost(F.when(_of_month(now), F.col("cost"))).alias("mtd_cost"))


def month_window(now: dt.datetime, days: int) -> int:
    """The days of a window that holds the last `days` days and all of the month so far."""
    return max(days, now.day)


def days_axis(spark: SparkSession, today: dt.date, days: int) -> DataFrame:
    first = today - dt.timedelta(days=max(1, days) - 1)
    return spark.range(max(1, days)).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))


def ranked(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return rows.withColumn(name, F.row_number().over(window.orderBy(*order)))
