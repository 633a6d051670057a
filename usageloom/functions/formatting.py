"""Display texts. Numbers are rounded by Java's rules (half up); compare numbers, not texts, with engines that round otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageloom.functions.scalars import clamp


def _scaled(n: Column, thousands: str) -> Column:
    size = F.abs(n)
    text = F.when(size < 1_000, n.cast("string")).when(size < 1_000_000, F.format_string(thousands, n / 1e3))
    return text.when(size < 1_000_000_000, F.format_string("%.1fM", n / 1e6)).otherwise(F.format_string("%.1fB", n / 1e9))


def count_text(n: Column) -> Column:
    """27.0K, 5.4M, 4.9B."""
    return _scaled(n, "%.1fK")


def short_count_text(n: Column) -> Column:
    """27K, 5.4M, 4.9B."""
    return _scaled(n, "%.0fK")


def currency(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"$%.{digits}f", value))


def compact_currency(value: Column) -> Column:
    return F.when(F.abs(value) >= 1_000, F.format_string("$%.1fK", value / 1e3)).otherwise(currency(value))


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def countdown(seconds: Column) -> Column:
    """The two largest units, minutes rounded up: 1d 3h, 2h 15m, 45m."""
    total = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.0), seconds) / 60)).cast("long")
    days, hours, minutes = F.floor(total / 1440), F.floor(total / 60) % 24, total % 60
    long = F.when(hours > 0, F.format_string("%dd %dh", days, hours)).otherwise(F.format_string("%dd", days))
    middle = F.when(minutes > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dh", hours))
    return F.when(days > 0, long).when(hours > 0, middle).otherwise(F.format_string("%dm", minutes))


def forecast_text(minutes: Column) -> Column:
    """~2h 15m or ~45min; null where there is no finite forecast."""
    total = F.greatest(F.lit(1), F.round(minutes)).cast("long")
    text = F.when(total < 60, F.format_string("~%dmin", total)).otherwise(F.format_string("~%dh %dm", F.floor(total / 60), total % 60))
    return F.when((minutes >= 0) & (minutes < float("inf")), text)


def duration_text(seconds: Column) -> Column:
    total = F.round(seconds).cast("long")
    days, hours, minutes = F.floor(total / 86400), F.floor(total % 86400 / 3600), F.floor(total % 3600 / 60)
    text = F.when(total < 60, "now").when(days > 0, F.format_string("%dd %dh", days, hours))
    return text.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def updated_text(seconds: Column) -> Column:
    age = F.greatest(F.lit(0.0), seconds)
    minutes, hours, days = (F.round(age / x).cast("long") for x in (60, 3600, 86400))
    text = F.when(age < 45, "just now").when(minutes < 60, F.format_string("%dm ago", F.greatest(F.lit(1), minutes)))
    return text.when(hours < 24, F.format_string("%dh ago", hours)).otherwise(F.format_string("%dd ago", days))


def remaining_text(left: Column) -> Column:
    return F.when(left.isNotNull(), F.format_string("%d%%", F.round(clamp(left)).cast("long")))


def title_text(left: Column, pace: Column) -> Column:
    """The share left, with the pace where it is ahead; a leading blank where it stands alone; null without a window."""
    ahead = F.concat(remaining_text(left), F.format_string(" · +%d%%", F.round(pace).cast("long")))
    return F.when(pace > 0, ahead).otherwise(F.concat(F.lit(" "), remaining_text(left)))


def menu_text(mode: Column, left: Column, cost_today: Column, seconds: Column) -> Column:
    """What a status item shows: the share left, today's cost or the time to the reset; null where that isn't known."""
    return F.when(mode == "percentRemaining", remaining_text(left)).when(mode == "costToday", currency(cost_today)).when(mode == "timeUntilReset", reset_text(seconds))


def reset_line(at: Column, seconds: Column, absolute: Column) -> Column:
    """The clock time of a reset, or the countdown to it; null without a reset."""
    return F.when(at.isNull(), None).when(absolute, F.concat(F.lit("Resets "), F.date_format(at, "HH:mm"))).otherwise(F.concat(F.lit("Resets in "), countdown(seconds)))


def percent_line(utilization: Column, show_used: Column) -> Column:
    used, left = F.round(utilization).cast("long"), F.round(100 - utilization).cast("long")
    return F.when(show_used, F.format_string("%d%% used", used)).otherwise(F.format_string("%d%% left", left))


def weekday_name(day: Column) -> Column:
    """Of 0 (Sunday) to 6; any other number as it is."""
    names = F.array(*[F.lit(x) for x in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")])
    return F.when(day.between(0, 6), F.get(names, day.cast("int"))).otherwise(day.cast("string"))


def busiest_text(day: Column, cost: Column) -> Column:
    return F.when(day.isNull(), "—").otherwise(F.concat(weekday_name(day), F.lit(" · "), currency(cost)))


def alert_post(window_id: Column, alert: Column, left: Column) -> Column:
    """struct<id, body> of the message that an alert posts: a threshold's number, `depleted` or `restored`."""
    edge = alert.isin("depleted", "restored")
    name = F.when(edge, F.concat_ws("-", alert, window_id)).otherwise(F.concat_ws("-", F.lit("threshold"), window_id, alert))
    ended = F.concat(window_id, F.when(alert == "depleted", " quota exhausted").otherwise(" quota restored"))
    return F.struct(name.alias("id"), F.when(edge, ended).otherwise(F.concat(window_id, F.lit(" at "), remaining_text(left), F.lit(" remaining"))).alias("body"))


def reset_text(seconds: Column) -> Column:
    """2h34 or 45min; null once it is past."""
    minutes = F.floor(seconds / 60).cast("long")
    text = F.when(minutes >= 60, F.format_string("%dh%02d", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%dmin", minutes))
    return F.when(seconds > 0, text)


def pace_label(status: Column, delta: Column, expected: Column) -> Column:
    size = F.round(F.abs(delta)).cast("long")
    text = F.when(status == "onPace", "On pace").when(status == "deficit", F.format_string("%d%% in deficit", size)).otherwise(F.format_string("%d%% in reserve", size))
    return F.concat(text, F.format_string(" - %d%%", F.round(expected).cast("long")))


def run_out_label(lasts: Column, seconds: Column) -> Column:
    """seconds until the projected run-out; null where there is none."""
    return F.when(lasts, "Lasts until reset").when(seconds <= 0, "Runs out now").when(seconds.isNotNull(), F.concat(F.lit("Runs out in "), duration_text(seconds)))


def day_range(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "").otherwise(F.concat(F.date_format(start, "dd/MM"), F.lit(" – "), F.date_format(end, "dd/MM")))


def hour_text(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def total_text(tokens: Column, cost: Column) -> Column:
    return F.concat(F.lit("Total: "), count_text(tokens), F.lit(" tokens · "), compact_currency(cost))


def shows_forecast(mode: Column, has_pace: Column, minutes: Column) -> Column:
    """In text mode, or in bar mode without a pace, and only for a finite forecast."""
    shown = (mode == "text") | ((mode == "bar") & ~has_pace)
    return shown & F.coalesce((minutes >= 0) & (minutes < float("inf")), F.lit(False))
