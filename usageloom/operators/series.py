"""Per-key operators on sample series: bounded history, slopes, forecasts, pace, edge alerts and carry-forward.

What needs the previous row of a key is taken in time slices: a key's slices are separate groups, and only one value of
each slice goes on to the next, so that a key with very many rows isn't one task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.functions.scalars import clamp

HISTORY, RECENT, SPARK = 20, 10, 8
#: Samples that a forecast needs, and those for a sure one; minutes at which it alerts; what counts as used up.
LEAST_SAMPLES, SURE_SAMPLES, ALERT_MINUTES, USED_UP = 3, 5, 30, 0.0001
LEAST_EXPECTED, ON_PACE = 3.0, 2.0
WINDOW_IDS = ["session", "weekly", "sonnet", "opus", "dailyRoutines"]


def local_seconds(ts: Column) -> Column:
    """Seconds from 2024-01-01 of a local time, whatever the session's zone."""
    whole = F.datediff(ts, F.lit("2024-01-01").cast("date")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole + F.extract(F.lit("SECOND"), ts).cast("double")


def last_n(samples: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """Each key's last n rows, with `age` (1 is the newest). The planner drops older rows before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return samples.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def recent_values(samples: DataFrame, key: str, order: Sequence[str], value: str, n: int) -> DataFrame:
    """Each key's last n values, oldest first; none for n of 0 or less."""
    rows = last_n(samples, key, order, max(n, 0)).groupBy(key)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("place"), F.col(value).alias("value"))))  # n rows at most
    return rows.agg(F.transform(pairs, lambda p: p.value).alias("values"))


def add_samples(new: DataFrame, key: str, order: Sequence[str], store: str, run: int) -> None:
    """Write the history that is stored after a run: the last HISTORY of what the run before stored and of the new samples.

    A run's folder is written whole, so a run that is repeated replaces its own; the earlier one stays until it is deleted.
    """
    before = stored_samples(new.sparkSession, store, run - 1) if run else new.limit(0)
    last_n(before.select(*new.columns).unionByName(new), key, order, HISTORY).drop("age").write.mode("overwrite").parquet(f"{store}/run={run}")


def stored_samples(spark: SparkSession, store: str, run: int) -> DataFrame:
    return spark.read.parquet(f"{store}/run={run}")


def sparkline(series: DataFrame, values: str = "values") -> DataFrame:
    """Heights from 0 to 1 of the last values over their largest; 0.5 throughout if that is 0 or there is one sample."""
    v = F.transform(F.col(values), lambda x: clamp(x))
    most = F.array_max(v)
    flat = (F.size(v) <= 1) | (most <= 0)
    return series.withColumn("heights", F.transform(v, lambda x: F.when(flat, 0.5).otherwise(F.round(x / F.nullif(most, F.lit(0.0)), 6))))


def slope(samples: DataFrame, key: str, value: str, ts: str = "ts", where: Column | None = None) -> list[Column]:
    """Aggregates: the number of samples, and the least-squares rate a second (null without spread in time)."""
    x = local_seconds(F.col(ts))
    y = F.col(value) if where is None else F.when(where, F.col(value))
    return [F.count(y).alias("n_recent"), F.regr_slope(y, x).alias("slope")]


def forecast_ladder(n: Column, n_recent: Column, rate: Column, current: Column, until_reset: Column) -> tuple[Column, Column]:
    """(minutes left or null, confidence): calculating, stable, low or high."""
    left = (100 - clamp(current)) / F.nullif(rate, F.lit(0.0))
    known, rising = (n >= LEAST_SAMPLES) & rate.isNotNull(), F.coalesce(rate > 0, F.lit(False))
    in_time = known & rising & (left >= 0) & (left <= until_reset)
    label = F.when(~known, "calculating").when(~rising, "stable").when(left > until_reset, "low")
    return F.when(in_time, left / 60), label.when(n_recent >= SURE_SAMPLES, "high").otherwise("low")


def forecasts(samples: DataFrame, key: str, order: Sequence[str], value: str, until_reset: str) -> DataFrame:
    """One row a key, from its last HISTORY samples; the slope is that of the last RECENT."""
    history = last_n(samples, key, order, HISTORY)
    recent = F.col("age") <= RECENT
    now = F.col("age") == 1
    sums = history.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        *slope(history, key, value, where=recent),
        F.max(F.when(now, F.col(value))).alias("current"),
        F.max(F.when(now, F.col(until_reset))).alias("until_reset"),
    )
    minutes, label = forecast_ladder(F.col("n"), F.col("n_recent"), F.col("slope"), F.col("current"), F.col("until_reset"))
    return sums.select(key, "n", "slope", minutes.alias("minutes"), label.alias("confidence"))


def running_forecasts(samples: DataFrame, key: str, order: Sequence[str], value: str, until_reset: str, slice_: Column | None = None) -> DataFrame:
    """Adds to each sample the forecast as of it. slice_ (the day of ts) must not fall along the order.

    A slice is a group of its own, led in by the HISTORY - 1 rows before it, which are taken from the slices' last rows.
    """
    cut = samples.withColumn("slice_", F.to_date("ts") if slice_ is None else slice_)
    wanted = list(dict.fromkeys([*order, value, "ts"]))
    newest = Window.partitionBy(key, "slice_").orderBy(*[F.col(c).desc() for c in order])
    last = cut.select(key, "slice_", F.struct(*wanted).alias("row_"), F.row_number().over(newest).alias("age_")).where(F.col("age_") < HISTORY)
    by_age = F.sort_array(F.collect_list(F.struct("age_", "row_")), asc=False)  # HISTORY - 1 rows at most, oldest first
    tails = last.groupBy(key, "slice_").agg(F.transform(by_age, lambda x: x["row_"]).alias("own_"))
    # Every slice has a row, so no more slices than rows are needed.
    slices = Window.partitionBy(key).orderBy("slice_").rowsBetween(1 - HISTORY, -1)
    before = tails.withColumn("lead_", F.flatten(F.collect_list("own_").over(slices)))
    lead_in = F.slice("lead_", F.greatest(F.size("lead_") - HISTORY + 2, F.lit(1)), HISTORY - 1)
    leads = before.select(key, "slice_", F.explode(lead_in).alias("row_")).select(key, "slice_", *[F.col("row_")[c].alias(c) for c in wanted if c != key], F.lit(True).alias("lead_"))
    every = cut.withColumn("lead_", F.lit(False)).unionByName(leads, allowMissingColumns=True)
    whole = Window.partitionBy(key, "slice_").orderBy(F.col("lead_").desc(), *order)
    recent = whole.rowsBetween(1 - RECENT, 0)
    seen = every.withColumns({
        "n_": F.count(F.lit(1)).over(whole.rowsBetween(1 - HISTORY, 0)),
        "n_recent_": F.count(F.lit(1)).over(recent),
        "slope_": F.regr_slope(F.col(value), local_seconds(F.col("ts"))).over(recent),
    }).where(~F.col("lead_"))
    minutes, label = forecast_ladder(F.col("n_"), F.col("n_recent_"), F.col("slope_"), F.col(value), F.col(until_reset))
    return seen.select(*samples.columns, minutes.alias("minutes"), label.alias("confidence"))


def _with_slice(here: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Each row with what came before its slice; a null key or slice is a value like any other."""
    named = before.toDF("its_key_", "its_slice_", "before_")
    return here.join(named, F.col(key).eqNullSafe(F.col("its_key_")) & F.col("slice_").eqNullSafe(F.col("its_slice_")))


def previous(rows: DataFrame, key: str, order: Sequence[str], slice_: Column, value: Column, name: str = "previous") -> DataFrame:
    """Adds the value of the key's row before, null for the first. slice_ must not fall along the order; value is never null.

    A null key is a key like any other; a null slice is the first one, as nulls come first in the order.
    """
    cut = rows.withColumn("slice_", slice_).withColumn("value_", value)
    inside = Window.partitionBy(key, "slice_").orderBy(*order)
    here = cut.withColumn("lag_", F.lag("value_").over(inside))
    tails = cut.groupBy(key, "slice_").agg(F.max_by("value_", F.struct(*order)).alias("tail_"))
    before = tails.withColumn("before_", F.lag("tail_").over(Window.partitionBy(key).orderBy("slice_"))).select(key, "slice_", "before_")
    return _with_slice(here, before, key).select(*rows.columns, F.coalesce("lag_", "before_").alias(name))


def carried(rows: DataFrame, key: str, order: Sequence[str], slice_: Column, state: Column, name: str = "carried") -> DataFrame:
    """Adds the key's last state that isn't null, up to and including the row; null keys and slices as in `previous`."""
    cut = rows.withColumn("slice_", slice_).withColumn("state_", state)
    inside = Window.partitionBy(key, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumn("own_", F.last("state_", ignorenulls=True).over(inside))
    tails = cut.groupBy(key, "slice_").agg(F.max_by("state_", F.when(F.col("state_").isNotNull(), F.struct(*order))).alias("tail_"))
    earlier = Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    before = tails.withColumn("before_", F.last("tail_", ignorenulls=True).over(earlier)).select(key, "slice_", "before_")
    return _with_slice(here, before, key).select(*rows.columns, F.coalesce("own_", "before_").alias(name))


def crossed_threshold(current: Column, before: Column, thresholds: Column) -> Column:
    """The smallest threshold that the remaining share has just come down to; null for none."""
    return F.array_min(F.filter(thresholds, lambda t: (current <= t) & (before.isNull() | (before > t))))


def depletion_edge(current: Column, before: Column) -> Column:
    """`depleted` when the remaining share reaches nothing, `restored` when it comes back; at first it isn't depleted."""
    now, then = current <= USED_UP, F.coalesce(before <= USED_UP, F.lit(False))
    return F.when(now & ~then, "depleted").when(~now & then, "restored")


def is_near(minutes: Column) -> Column:
    return F.coalesce(minutes <= ALERT_MINUTES, F.lit(False))


def predictive_alert(near: Column, was_near: Column, current: Column) -> Column:
    """The first tick of a near forecast, unless all is used up already."""
    return near & ~F.coalesce(was_near, F.lit(False)) & (current > USED_UP)


def pace(utilization: Column, seconds_left: Column, window_minutes: Column) -> Column:
    """struct<expected, actual, delta, deficit, reserve, status, lasts, run_out_seconds>; null where no pace can be told."""
    span = window_minutes * 60.0
    passed = span - seconds_left
    expected = passed / F.nullif(span, F.lit(0.0)) * 100
    actual = clamp(utilization)
    delta = actual - expected
    run_out = (100 - actual) / F.nullif(actual, F.lit(0.0)) * passed
    lasts = (actual == 0) | (run_out >= seconds_left)
    status = F.when(F.abs(delta) <= ON_PACE, "onPace").when(delta > 0, "deficit").otherwise("reserve")
    told = (window_minutes > 0) & (seconds_left > 0) & (seconds_left <= span) & (expected >= LEAST_EXPECTED)
    found = F.struct(
        expected.alias("expected"), actual.alias("actual"), delta.alias("delta"), F.greatest(delta, F.lit(0.0)).alias("deficit"), F.greatest(-delta, F.lit(0.0)).alias("reserve"),
        status.alias("status"), lasts.alias("lasts"), F.when(~lasts, run_out).alias("run_out_seconds"),
    )
    return F.when(told, found)


def fan_out(snapshots: DataFrame, keep: Sequence[str], updated: str = "ts") -> DataFrame:
    """A row for each window that a snapshot holds: columns named as WINDOW_IDS are struct<utilization, resets_in>."""
    windows = F.array(*[F.when(F.col(w).isNotNull(), F.struct(F.lit(w).alias("window_id"), F.col(w).utilization.alias("utilization"), F.col(w).resets_in.alias("resets_in"))) for w in WINDOW_IDS])
    rows = snapshots.select(*keep, F.explode(F.filter(windows, lambda w: w.isNotNull())).alias("w"))
    resets = F.col("w.resets_in").cast("double")
    until = F.when(resets.isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), resets))
    return rows.select(*keep, "w.window_id", "w.utilization", until.alias("until_reset"))


def forecast_of(forecasts: Column, window_id: Column | str) -> Column:
    """The first of a list of forecasts (structs with window_id) that is the window's; null for none."""
    return F.get(F.filter(forecasts, lambda f: f.window_id == window_id), 0)


def hottest_first(session: Column, weekly: Column) -> Column:
    """The two windows' names; the weekly one leads only if it is there and strictly hotter."""
    swap = weekly.isNotNull() & (weekly > F.coalesce(session, F.lit(-1.0)))
    return F.when(swap, F.array(F.lit("weekly"), F.lit("session"))).otherwise(F.array(F.lit("session"), F.lit("weekly")))


def chosen_source(status: dict[str, Column]) -> Column:
    """The first source by priority that is ok. Statuses: ok, unavailable, auth, scope, failed; after another failure than auth or scope of the first source none follows."""
    names = ["oauth", "cli", "web"]
    stop = F.coalesce(~status["oauth"].isin("ok", "unavailable", "auth", "scope"), F.lit(False))
    return F.when(stop, F.lit(None).cast("string")).otherwise(F.coalesce(*[F.when(status[n] == "ok", F.lit(n)) for n in names]))
