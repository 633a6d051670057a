"""Scalar functions on columns: parsing, classification and arithmetic."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_8601 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"


def project_of(cwd: Column) -> Column:
    """The last component of a path; `Unknown` for none, `/` for the root."""
    last = F.try_element_at(F.filter(F.split(cwd, "/"), lambda x: F.length(x) > 0), F.lit(-1))
    blank = cwd.isNull() | (F.regexp_replace(cwd, r"\s", "") == "")
    return F.when(blank, "Unknown").when(last.isNull(), "/").otherwise(last)


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 with a zone, with or without fractional seconds; anything else is null."""
    return F.when(text.rlike(ISO_8601), F.try_to_timestamp(text))


def lenient_int(number: Column) -> Column:
    """A JSON number as a count: truncated, at least 0; what is missing or no number is 0."""
    return F.greatest(F.coalesce(number.cast("double").cast("long"), F.lit(0)), F.lit(0)).cast("long")


def volume(*tokens: Column) -> Column:
    return sum(tokens[1:], tokens[0])


def ratio(part: Column, whole: Column, otherwise: float | None = 0.0) -> Column:
    """part / whole where whole is positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise).cast("double"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def remaining(utilization: Column) -> Column:
    return 100.0 - utilization


def cost_days(days: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(365), days))


def log_scale(t: Column, least: Column, most: Column) -> Column:
    """Position on a log scale from the least non-zero value to the largest."""
    low, high = F.log1p(least), F.log1p(most)
    return F.when((most <= 0) | (t <= 0), 0.0).when(high <= low, 1.0).otherwise(clamp((F.log1p(t) - low) / (high - low), 0.0, 1.0))


def log_midpoint(most: Column) -> Column:
    return F.round(F.exp(F.log1p(most) / 2) - 1)


def lerp3(t: Column, low: tuple[float, ...], middle: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """array of channels, piecewise linear through three stops at 0, 0.5 and 1."""
    x = clamp(t, 0.0, 1.0)
    return F.array(*[F.when(x < 0.5, a + (b - a) * x * 2).otherwise(b + (c - b) * (x - 0.5) * 2) for a, b, c in zip(low, middle, high, strict=True)])


def risk_zone(utilization: Column) -> Column:
    return F.when(utilization < 70, "normal").when(utilization < 90, "warning").otherwise("critical")


def back_off_seconds(failures: Column) -> Column:
    """300 seconds, doubled with each failure, six hours at most."""
    return F.when(failures <= 0, 0.0).otherwise(F.least(300 * F.pow(F.lit(2.0), F.least(failures, F.lit(30)) - 1), F.lit(21600.0)))


def retry_at(header: Column, now: Column) -> Column:
    """Retry-After: seconds from now, or an RFC 1123 date."""
    text = F.regexp_replace(header, r"^\s+|\s+$", "")
    seconds = text.try_cast("double")
    after = F.timestamp_micros(F.unix_micros(now) + F.round(seconds * 1_000_000).cast("long"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), r" (GMT|UTC)$", " +0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.when(seconds >= 0, after).otherwise(date)


#: Plans in the order in which they are looked for, and their list prices.
PLANS = ["max", "pro", "team", "enterprise", "ultra"]
PLAN_PRICES = {"max": 200.0, "pro": 20.0}


def plan_of(subscription: Column, tier: Column) -> Column:
    """The first plan that is a word of the subscription, else that the tier's text holds."""
    words = F.split(F.lower(F.coalesce(subscription, F.lit(""))), r"[^\p{L}\p{N}]+")
    lowered = F.lower(F.coalesce(tier, F.lit("")))
    return F.coalesce(*[F.when(F.array_contains(words, p), F.lit(p)) for p in PLANS], *[F.when(lowered.contains(p), F.lit(p)) for p in PLANS])


def plan_price(plan: Column) -> Column:
    return F.coalesce(*[F.when(plan == p, F.lit(price)) for p, price in PLAN_PRICES.items()])


def roi_multiplier(cost: Column, price: Column) -> Column:
    return F.when((price > 0) & (cost > 0), F.round(cost / F.nullif(price, F.lit(0.0)))).cast("long")


def version_parts(version: Column) -> Column:
    """The leading numeric components of a dotted version; empty ones between dots don't count."""
    parts = F.filter(F.split(version, r"\."), lambda p: F.length(p) > 0)
    start = F.struct(F.lit(True).alias("going"), F.expr("cast(array() as array<int>)").alias("out"))

    def add(done: Column, part: Column) -> Column:
        number = F.when(part.rlike(r"^[+-]?\d{1,9}$"), part).cast("int")
        going = done.going & number.isNotNull()
        return F.struct(going.alias("going"), F.when(going, F.concat(done.out, F.array(number))).otherwise(done.out).alias("out"))

    return F.aggregate(parts, start, add, lambda done: done.out)


def is_newer(remote: Column, local: Column) -> Column:
    """Component by component; on a tie the longer version wins, which is how arrays compare."""
    return version_parts(remote) > version_parts(local)


def utf16_units(text: Column) -> Column:
    """array<long>: the numbers of a text's UTF-16 code units; two for a character beyond the basic plane."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def composed(text: Column) -> Column:
    """Canonically composed (NFC), for which there is no function on the JVM's side."""

    def compose(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(compose, "string")(text)


def string_hash(text: Column) -> Column:
    """h = 31 h + UTF-16 code unit in 32 bits, as the magnitude in base 36."""
    units = utf16_units(text)
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))
    return F.lower(F.conv(F.abs(h).cast("string"), 10, 36))


def directory_name(path: Column, longest: int = 200) -> Column:
    """A composed path with other UTF-16 units than ASCII letters and digits as dashes; longer ones are cut and tagged with their hash."""
    clean = F.regexp_replace(F.regexp_replace(path, r"[\x{10000}-\x{10FFFF}]", "--"), "[^0-9A-Za-z]", "-")
    return F.when(F.length(clean) <= longest, clean).otherwise(F.concat(F.substring(clean, 1, longest), F.lit("-"), string_hash(path)))


def markers(thresholds: Column, show_used: Column) -> Column:
    """Warning marks on a bar, those on its edges left out."""
    at = F.transform(thresholds, lambda t: F.when(show_used, 100.0 - t).otherwise(t.cast("double")))
    return F.filter(at, lambda x: (x > 0) & (x < 100))


def workday_markers(days: Column) -> Column:
    """A mark at the end of each workday but the last, for two to seven of them."""
    spread = F.transform(F.sequence(F.lit(1), F.greatest(days - 1, F.lit(1))), lambda d: d * 100.0 / days)
    return F.when(days.between(2, 7), spread).otherwise(F.expr("cast(array() as array<double>)"))


def all_markers(thresholds: Column, show_used: Column, days: Column) -> Column:
    """Both kinds; sorted only where there are workday marks."""
    both = F.concat(markers(thresholds, show_used), workday_markers(days))
    return F.when(days.between(2, 7), F.array_sort(both)).otherwise(both)


def clean_thresholds(values: Column) -> Column:
    """1 to 100, distinct, largest first."""
    return F.sort_array(F.array_distinct(F.filter(values, lambda t: t.between(1, 100))), asc=False)


def input_thresholds(first: Column, second: Column) -> Column:
    """Two entries of a form, each brought into 1 to 99, largest first."""
    return F.sort_array(F.array(*[F.greatest(F.lit(1), F.least(F.lit(99), x)) for x in (first, second)]), asc=False)


def extra_usage_percent(utilization: Column, used: Column, limit: Column) -> Column:
    return F.when(utilization.isNotNull(), clamp(utilization)).when(limit > 0, clamp(used / F.nullif(limit, F.lit(0.0)) * 100)).otherwise(0.0)


def quantised(value: Column) -> Column:
    """Tenths, -1 for none."""
    return F.coalesce(F.round(value * 10).cast("long"), F.lit(-1).cast("long"))


def bar_geometry(utilization: Column, pace: Column, width: float) -> Column:
    """struct<fill, mark, zone_start, zone_end, visible> of a progress bar with a pace mark."""
    fill, mark = clamp(utilization) / 100 * width, clamp(pace) / 100 * width
    low, high = F.least(fill, mark), F.greatest(fill, mark)
    return F.struct(fill.alias("fill"), mark.alias("mark"), low.alias("zone_start"), high.alias("zone_end"), (high - low > 0.5).alias("visible"))


def is_stale(updated_at: Column, now: Column, has_error: Column) -> Column:
    """An error, or older than five minutes."""
    return has_error | (F.unix_micros(now) - F.unix_micros(updated_at) > 300_000_000)


def is_critical(stale: Column, has_error: Column, *left: Column) -> Column:
    """Fresh, and a window that is there has 10 % or less left."""
    low = F.lit(False)
    for x in left:
        low = low | F.coalesce(x <= 10, F.lit(False))
    return low & ~stale & ~has_error
