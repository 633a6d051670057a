"""Second-level results of a period: all start from the (day, model) roll-up, the dense day axis or the heatmap, which are small."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from usageloom.functions.models import CACHE_READ_SHARE, default_price, price_table
from usageloom.functions.scalars import lerp3, log_midpoint, log_scale, ratio, volume, weekday
from usageloom.operators.aggregates import DIGITS, days_axis, ranked, total, total_cost
from usageloom.operators.clean import TOKENS

#: The heat scale's colours at 0, 0.5 and 1 (of 255), and the days between an axis's ticks by period.
HEAT_STOPS = ((42, 26, 19), (204, 124, 94), (247, 220, 196))
TICK_STRIDES = {7: 1, 30: 4, 90: 14}


def all_tokens() -> Column:
    return volume(*[F.col(c) for c in TOKENS])


def everything() -> WindowSpec:
    """One window over a small table: a row for each day, model or cell."""
    return Window.partitionBy(F.lit(0))


def daily_axis(by_day_model: DataFrame, today: dt.date, days: int) -> DataFrame:
    """Each day of the period with its cost and tokens, zeros where nothing was used; `tokens` are input and output."""
    sums = by_day_model.groupBy("day").agg(*[total(c).alias(c) for c in TOKENS], total_cost().alias("cost"))
    axis = days_axis(by_day_model.sparkSession, today, days).join(sums, "day", "left").na.fill(0, [*TOKENS, "cost"])
    return axis.select("day", "cost", *TOKENS, (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), all_tokens().alias("volume")).orderBy("day")


def by_model(by_day_model: DataFrame) -> DataFrame:
    sums = by_day_model.groupBy("model").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total_cost().alias("cost"))
    return sums.orderBy(F.desc("cost"), "model")


def by_day_by_model(by_day_model: DataFrame) -> DataFrame:
    return by_day_model.groupBy("day", "model").agg(total(all_tokens()).alias("volume")).orderBy("day", "model")


def period_windows(axis: DataFrame, today: dt.date) -> DataFrame:
    """One row: cost and tokens of today, the last seven days and the period, their daily averages, and the axis's bounds."""
    now, week = F.col("day") == F.lit(today), F.col("day") > F.lit(today - dt.timedelta(days=7))
    sums = axis.agg(
        total_cost(F.when(now, F.col("cost"))).alias("today_cost"),
        total(F.when(now, F.col("tokens"))).alias("today_tokens"),
        total_cost(F.when(week, F.col("cost"))).alias("week_cost"),
        total(F.when(week, F.col("tokens"))).alias("week_tokens"),
        total_cost().alias("period_cost"),
        total("tokens").alias("period_tokens"),
        total("volume").alias("period_volume"),
        F.count(F.lit(1)).alias("span"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    average = F.round(F.col("period_cost") / F.greatest("span", F.lit(1)), DIGITS)
    return sums.select("*", average.alias("average_cost"), F.floor(F.col("period_tokens") / F.greatest("span", F.lit(1))).cast("long").alias("average_tokens"))


def projection(mtd: DataFrame, windows: DataFrame, now: dt.datetime) -> DataFrame:
    """Month's cost at the rate so far, and the tokens it would buy at the period's price."""
    month_days = calendar.monthrange(now.year, now.month)[1]
    projected = mtd.select("mtd_cost", F.round(F.col("mtd_cost") / max(1, now.day) * month_days, DIGITS).alias("projected_cost"))
    tokens = F.when(F.col("period_cost") > 0, F.round(F.col("period_volume") / F.nullif("period_cost", F.lit(0.0)) * F.col("projected_cost"))).otherwise(0.0)
    return projected.join(windows.select("period_cost", "period_volume"), F.lit(True), "inner").select("mtd_cost", "projected_cost", tokens.cast("long").alias("projected_tokens"))


def cache_hit_rate(axis: DataFrame) -> DataFrame:
    read, fresh = total("cache_read"), total("input_tokens")
    return axis.agg(F.round(ratio(read, read + fresh), DIGITS).alias("hit_rate"))


def cache_savings(axis: DataFrame, models: DataFrame) -> DataFrame:
    """What the cached tokens would have cost at the price of the model that cost most (ties: the lesser name)."""
    prices = price_table(axis.sparkSession)
    low, high = default_price()
    top = models.orderBy(F.desc("cost"), "model").limit(1).select("model")
    price = top.join(prices, "model", "left").select(F.col("model").alias("dominant_model"), F.coalesce("price_in", F.lit(low)).alias("p"), F.coalesce("price_out", F.lit(high)).alias("q"))
    saved = F.col("cache_read") * F.greatest(F.lit(0.0), F.col("q") - CACHE_READ_SHARE * F.col("p"))
    found = axis.agg(total("cache_read").alias("cache_read")).join(price, F.lit(True), "left")
    return found.select("dominant_model", F.round(F.coalesce(saved, F.lit(0.0)), DIGITS).alias("savings"))


def daily_delta(windows: DataFrame) -> DataFrame:
    """How far today is from the daily average; null without use today or in the period."""
    used = (F.col("today_tokens") > 0) & (F.col("average_cost") > 0)
    return windows.select(F.when(used, F.round(F.col("today_cost") / F.nullif("average_cost", F.lit(0.0)) - 1, 6)).alias("delta"))


def peak_hour(heat: DataFrame) -> DataFrame:
    """The hour with most tokens over all weekdays; ties and no use give the earliest."""
    return heat.groupBy("hour").agg(F.sum("tokens").alias("tokens")).agg(F.min_by("hour", F.struct(-F.col("tokens"), F.col("hour"))).alias("peak_hour"))


def busiest_weekday(axis: DataFrame) -> DataFrame:
    """The weekday that cost most, of days with a cost; ties: the earlier in the week; no row where nothing cost."""
    days = axis.where("cost > 0").groupBy(weekday(F.col("day")).alias("weekday")).agg(total_cost().alias("cost"))
    return days.orderBy(F.desc("cost"), "weekday").limit(1)


def top_model(by_day_model: DataFrame) -> DataFrame:
    return by_day_model.groupBy("model").agg(total(all_tokens()).alias("volume")).orderBy(F.desc("volume"), "model").limit(1)


def model_overflow(models: DataFrame, n: int = 5) -> DataFrame:
    """The n models that cost most with their share of the largest, and one row `other` for the rest: their number and cost."""
    order = ranked(models.withColumn("tokens", F.col("input_tokens") + F.col("output_tokens")), F.desc("cost"), "model")
    top = order.withColumn("bar", F.round(ratio(F.col("cost"), F.max("cost").over(everything())), DIGITS))
    shown = top.where(F.col("rank") <= n).select("rank", "model", "tokens", "cost", "bar", F.lit(1).cast("long").alias("n_models"))
    rest = order.where(F.col("rank") > n).agg(total("tokens").alias("tokens"), total_cost().alias("cost"), F.count(F.lit(1)).alias("n_models")).where("n_models > 0")
    other = rest.select(F.lit(n + 1).alias("rank"), F.lit("other").alias("model"), "tokens", "cost", F.lit(None).cast("double").alias("bar"), "n_models")
    return shown.unionByName(other)


def model_share(models: DataFrame) -> DataFrame:
    share = ratio(F.col("cost"), F.sum("cost").over(everything()))
    return models.select("model", "cost", F.round(share, 6).alias("share"), F.round(share * 100).cast("int").alias("percent"))


def palette_index(models: DataFrame, n_colours: int = 8) -> DataFrame:
    """A model's colour: its rank by cost, over and over."""
    return ranked(models, F.desc("cost"), "model").select("model", ((F.col("rank") - 1) % n_colours).cast("int").alias("colour"))


def tokens_long(axis: DataFrame) -> DataFrame:
    return axis.unpivot("day", TOKENS, "kind", "tokens")


def heat_scale(heat: DataFrame) -> DataFrame:
    """Each cell's place between the least non-zero and the largest on a log scale, its colour, and the scale's middle."""
    least = F.coalesce(F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).over(everything()), F.lit(0))
    most = F.max("tokens").over(everything())
    scaled = heat.select("weekday", "hour", "tokens", least.alias("least"), most.alias("most"))
    level = log_scale(F.col("tokens"), F.col("least"), F.col("most"))
    coloured = scaled.withColumn("level", level).withColumn("rgb", lerp3(F.col("level"), *HEAT_STOPS))  # of 255
    channels = [F.round(F.get("rgb", i) / 255, 6).alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return coloured.select("weekday", "hour", "tokens", F.round("level", 6).alias("level"), *channels, log_midpoint(F.col("most")).cast("long").alias("middle"))


def cumulative_cost(axis: DataFrame) -> DataFrame:
    """The running cost; the axis has a row for each day of the period only."""
    return axis.select("day", "cost", F.round(F.sum("cost").over(everything().orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), DIGITS).alias("running_cost"))


def cost_band(models: DataFrame, values: list[float]) -> DataFrame:
    """For each value the first model, by falling cost, at which the running cost reaches it; beyond all, the last."""
    order = ranked(models, F.desc("cost"), "model")
    running = order.withColumn("running", F.round(F.sum("cost").over(everything().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)), DIGITS))
    bands = running.agg(F.array_sort(F.collect_list(F.struct("rank", "running", "model"))).alias("bands"))  # a model a row
    asked = models.sparkSession.createDataFrame([(float(v),) for v in values], "value double").join(bands, F.lit(True), "inner")
    hit = F.coalesce(F.get(F.filter("bands", lambda b: b.running >= F.col("value")), 0), F.try_element_at("bands", F.lit(-1)))
    return asked.select("value", hit.model.alias("model"))


def day_top_models(by_day: DataFrame, n: int = 6) -> DataFrame:
    """Of each day the n models with most tokens."""
    return ranked(by_day.where("volume > 0"), F.desc("volume"), "model", by=("day",)).where(F.col("rank") <= n).select("day", "rank", "model", "volume")


def day_models(by_day: DataFrame, day: dt.date) -> DataFrame:
    """The models of one day."""
    return by_day.where((F.col("day") == F.lit(day)) & (F.col("volume") > 0)).orderBy(F.desc("volume"), "model")


def axis_ticks(axis: DataFrame, days: int) -> DataFrame:
    first = F.min("day").over(everything())
    return axis.withColumn("n", F.datediff("day", first)).where(F.col("n") % TICK_STRIDES.get(days, 1) == 0).select("day")


def csv_rows(axis: DataFrame) -> DataFrame:
    """The export's rows: the cost as text with four digits."""
    return axis.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.format_string("%.4f", "cost").alias("cost_usd"), "input_tokens", "output_tokens",
        F.col("cache_read").alias("cache_read_tokens"), F.col("cache_write").alias("cache_write_tokens"),
    )


def export_name(days: int, today: dt.date) -> str:
    return f"claude-usage-{days}d-{today:%Y-%m-%d}.csv"


def write_csv(axis: DataFrame, path: str) -> None:
    """One file with a header; the axis has a row for each day only. Spark's committer shows it whole or not at all."""
    csv_rows(axis).coalesce(1).sortWithinPartitions("date").write.option("header", "true").csv(path)


def is_empty(by_day_model: DataFrame) -> DataFrame:
    return by_day_model.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))
