"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions import formatting as fmt
from usageloom.functions import models
from usageloom.functions import scalars as fn
from usageloom.plans.usage import Query, load
from usageloom.sources.usage import raw_model

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, table: str, columns: Callable[[], list[Column | str]], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, table).select(*columns())

    QUERIES[name], ORACLE[name] = query, sql


def e_id() -> Column:
    return F.col("event_id")


def value() -> Column:
    return F.col("value")


def k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("double")


def path() -> Column:
    """An URL without its scheme, query and fragment."""
    return F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")


def age() -> Column:
    return (e_id() * 7919 % 300000).cast("double")


def broken() -> Column:
    return F.col("event_type") == "error"


def stale() -> Column:
    return fn.is_stale(F.col("ts").cast("timestamp"), F.lit("2024-01-30 23:59:00").cast("timestamp"), broken())


_add(
    "model_names", "events", lambda: ["event_id", models.normal_model(raw_model(F.col("event_type"))).alias("model"), models.display_name(models.normal_model(raw_model(F.col("event_type")))).alias("shown")],
    """SELECT event_id, model, regexp_replace(model, '^claude-', '') AS shown FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'claude-opus-4' WHEN 'view' THEN 'claude-sonnet-4'
      WHEN 'purchase' THEN 'claude-3-5-sonnet' WHEN 'signup' THEN 'claude-haiku-3-5' ELSE 'event-' || event_type END AS model FROM events)""",
)
_add(
    "json_props", "events", lambda: ["event_id", fn.lenient_int(k()).alias("k"), fn.lenient_int(value() - 20).alias("above")],
    """SELECT event_id, greatest(CAST(trunc(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS BIGINT), 0) AS k,
      greatest(CAST(trunc(coalesce(value - 20, 0)) AS BIGINT), 0) AS above FROM events""",
)
SQL_PATH = "regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g')"
_add(
    "project_names", "pages", lambda: ["page_id", fn.project_of(F.when(F.col("page_id") % 5 != 0, path())).alias("project")],
    f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Unknown' ELSE list_filter(string_split({SQL_PATH}, '/'), lambda x: length(x) > 0)[-1] END AS project FROM pages",
)
_add(
    "path_hash", "pages", lambda: ["page_id", fn.string_hash(F.col("url")).alias("hash"), fn.directory_name(fn.composed(F.col("url")), 30).alias("name")],
    r"""WITH h AS (SELECT page_id, url, abs(list_reduce(list_transform(string_split(url, ''), lambda c: CAST(ord(c) AS BIGINT)),
        lambda a, c: ((((a * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648, CAST(0 AS BIGINT))) AS n FROM pages),
      digits AS (SELECT page_id, url, list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: CAST(n // CAST(pow(36, i) AS BIGINT) % 36 AS BIGINT)) AS d FROM h),
      hashed AS (SELECT page_id, url, ltrim(list_reduce(list_transform(d, lambda x: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(x + 1 AS INTEGER), 1)), lambda a, b: a || b), '0') AS hash FROM digits)
      SELECT page_id, hash, CASE WHEN length(url) <= 30 THEN regexp_replace(url, '[^0-9A-Za-z]', '-', 'g')
        ELSE substr(regexp_replace(url, '[^0-9A-Za-z]', '-', 'g'), 1, 30) || '-' || hash END AS name FROM hashed""",
)
_version = lambda *xs: F.concat_ws(".", *[x.cast("string") for x in xs])
_add(
    "semver_compare", "events",
    lambda: ["event_id", fn.is_newer(_version(e_id() % 3, e_id() % 5, e_id() % 7), _version(e_id() % 2, e_id() % 4)).alias("newer"), fn.is_newer(F.concat(_version(e_id() % 3, e_id() % 5), F.lit("-rc1")), _version(e_id() % 3)).alias("candidate")],
    """SELECT event_id, CASE WHEN event_id % 3 <> event_id % 2 THEN event_id % 3 > event_id % 2 WHEN event_id % 5 <> event_id % 4 THEN event_id % 5 > event_id % 4 ELSE true END AS newer,
      false AS candidate FROM events""",
)
_add(
    "iso_times", "events",
    lambda: ["event_id", (fn.iso_timestamp(F.when(e_id() % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e_id() % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS+02:00")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).cast("double")).alias("instant")],
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch_us(date_trunc('second', ts)) / 1e6 AS DOUBLE) WHEN 1 THEN CAST(epoch_us(date_trunc('milliseconds', ts)) / 1e6 - 7200 AS DOUBLE) END AS instant FROM events",
)
_add(
    "risk_zones", "events",
    lambda: [
        "event_id", fn.risk_zone(F.least(F.lit(100.0), value())).alias("zone"), F.round(fn.remaining(fn.clamp(value())), 6).alias("remaining"), fn.quantised(F.when(e_id() % 4 != 0, F.floor(value()) + 0.25)).alias("tenths"),
        F.round(fn.extra_usage_percent(F.when(e_id() % 3 == 0, value()), value(), (e_id() % 4 * 50).cast("double")), 6).alias("extra_percent"),
    ],
    """SELECT event_id, CASE WHEN least(100.0, value) < 70 THEN 'normal' WHEN least(100.0, value) < 90 THEN 'warning' ELSE 'critical' END AS zone,
      round(100 - greatest(0.0, least(100.0, value)), 6) AS remaining, CASE WHEN event_id % 4 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor(value) * 10 + 3 AS BIGINT) END AS tenths,
      round(CASE WHEN event_id % 3 = 0 THEN greatest(0.0, least(100.0, value)) WHEN event_id % 4 > 0 THEN greatest(0.0, least(100.0, value / (event_id % 4 * 50) * 100)) ELSE 0.0 END, 6) AS extra_percent FROM events""",
)
_add(
    "bar_geometry", "events",
    lambda: ["event_id", *[F.round(fn.bar_geometry(value(), k(), 200.0)[c], 6).alias(c) for c in ("fill", "mark", "zone_start", "zone_end")], fn.bar_geometry(value(), k(), 200.0).visible.alias("visible")],
    """SELECT event_id, round(f, 6) AS fill, round(m, 6) AS mark, round(least(f, m), 6) AS zone_start, round(greatest(f, m), 6) AS zone_end, abs(f - m) > 0.5 AS visible
      FROM (SELECT event_id, greatest(0.0, least(100.0, value)) / 100 * 200.0 AS f, greatest(0.0, least(100.0, CAST(json_extract_string(props, '$.k') AS DOUBLE))) / 100 * 200.0 AS m FROM events)""",
)
_add(
    "back_off", "events", lambda: ["event_id", fn.back_off_seconds(e_id() % 12 - 1).alias("seconds")],
    "SELECT event_id, CASE WHEN event_id % 12 - 1 <= 0 THEN 0.0 ELSE least(300 * pow(2.0, event_id % 12 - 2), 21600.0) END AS seconds FROM events",
)
_add(
    "threshold_sets", "events",
    lambda: ["event_id", F.array_join(fn.clean_thresholds(F.array(*[(e_id() % m - 5).cast("int") for m in (120, 90, 120)])), ",").alias("clean"), F.array_join(fn.input_thresholds(e_id() % 130, e_id() % 75), ",").alias("entered")],
    """SELECT event_id, array_to_string(list_reverse_sort(list_distinct(list_filter([event_id % 120 - 5, event_id % 90 - 5, event_id % 120 - 5], lambda t: t BETWEEN 1 AND 100))), ',') AS clean,
      array_to_string(list_reverse_sort([greatest(1, least(99, event_id % 130)), greatest(1, least(99, event_id % 75))]), ',') AS entered FROM events""",
)
_add(
    "workday_marks", "events",
    lambda: ["event_id", F.transform(fn.all_markers(F.array(e_id() % 101, e_id() % 37), e_id() % 2 == 0, (e_id() % 9).cast("int")), lambda x: F.round(x, 6)).cast("string").alias("marks")],
    """WITH m AS (SELECT event_id, event_id % 9 AS d, list_filter([CASE WHEN event_id % 2 = 0 THEN 100.0 - event_id % 101 ELSE CAST(event_id % 101 AS DOUBLE) END,
        CASE WHEN event_id % 2 = 0 THEN 100.0 - event_id % 37 ELSE CAST(event_id % 37 AS DOUBLE) END], lambda x: x > 0 AND x < 100) AS marks FROM events)
      SELECT event_id, CAST(CASE WHEN d BETWEEN 2 AND 7 THEN list_sort(list_concat(marks, list_transform(range(1, d), lambda i: round(i * 100.0 / d, 6)))) ELSE marks END AS VARCHAR) AS marks FROM m""",
)
_add(
    "durations", "events",
    lambda: ["event_id", fmt.countdown(age()).alias("countdown"), fmt.duration_text(age()).alias("duration"), fmt.reset_text(age() - 100).alias("reset"), fmt.updated_text(age() + 0.25).alias("updated"), fmt.forecast_text(age() / 60 + 0.001).alias("forecast")],
    """WITH s AS (SELECT event_id, CAST(event_id * 7919 % 300000 AS BIGINT) AS t FROM events), m AS (SELECT *, greatest(1, (t + 59) // 60) AS c, greatest(1, CAST(floor(t / 60.0 + 0.501) AS BIGINT)) AS f FROM s)
      SELECT event_id, CASE WHEN c >= 1440 AND c // 60 % 24 > 0 THEN printf('%dd %dh', c // 1440, c // 60 % 24) WHEN c >= 1440 THEN printf('%dd', c // 1440)
          WHEN c >= 60 AND c % 60 > 0 THEN printf('%dh %dm', c // 60, c % 60) WHEN c >= 60 THEN printf('%dh', c // 60) ELSE printf('%dm', c) END AS countdown,
        CASE WHEN t < 60 THEN 'now' WHEN t >= 86400 THEN printf('%dd %dh', t // 86400, t % 86400 // 3600) WHEN t >= 3600 THEN printf('%dh %dm', t // 3600, t % 3600 // 60) ELSE printf('%dm', t // 60) END AS duration,
        CASE WHEN t - 100 <= 0 THEN NULL WHEN t - 100 >= 3600 THEN printf('%dh%02d', (t - 100) // 3600, (t - 100) // 60 % 60) ELSE printf('%dmin', (t - 100) // 60) END AS reset,
        CASE WHEN t + 0.25 < 45 THEN 'just now' WHEN floor((t + 0.25) / 60 + 0.5) < 60 THEN printf('%dm ago', greatest(1, CAST(floor((t + 0.25) / 60 + 0.5) AS BIGINT)))
          WHEN floor((t + 0.25) / 3600 + 0.5) < 24 THEN printf('%dh ago', CAST(floor((t + 0.25) / 3600 + 0.5) AS BIGINT)) ELSE printf('%dd ago', CAST(floor((t + 0.25) / 86400 + 0.5) AS BIGINT)) END AS updated,
        CASE WHEN f < 60 THEN printf('~%dmin', f) ELSE printf('~%dh %dm', f // 60, f % 60) END AS forecast FROM m""",
)
_add(
    "menu_texts", "events",
    lambda: [
        "event_id",
        fmt.menu_text(F.element_at(F.array(*[F.lit(x) for x in ("percentRemaining", "costToday", "timeUntilReset", "icon")]), (e_id() % 4 + 1).cast("int")), F.when(e_id() % 3 > 0, 100 - value()), F.floor(value()) + 0.25, age() - 100).alias("menu"),
        fmt.title_text(F.when(e_id() % 3 > 0, F.floor(100 - value())), F.when(e_id() % 4 > 0, (e_id() % 9 - 4).cast("double"))).alias("title"),
        fmt.reset_line(F.when(e_id() % 5 > 0, F.col("ts")), age(), e_id() % 2 == 0).alias("resets"),
        fmt.percent_line(F.floor(F.least(F.lit(100.0), value())) + 0.25, e_id() % 2 == 0).alias("percent"),
        fmt.busiest_text(F.when(e_id() % 7 > 0, e_id() % 9), F.floor(value()) + 0.5).alias("busiest"),
    ],
    """WITH s AS (SELECT event_id, ts, value, event_id * 7919 % 300000 AS t, event_id * 7919 % 300000 - 100 AS r, greatest(1, (event_id * 7919 % 300000 + 59) // 60) AS c, CAST(floor(value) AS BIGINT) AS v,
        greatest(0, CAST(floor(100 - value) AS BIGINT)) AS l, event_id % 9 - 4 AS p FROM events)
      SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 > 0 THEN printf('%d%%', CAST(floor(greatest(0.0, 100 - value) + 0.5) AS BIGINT)) END WHEN 1 THEN printf('$%d.25', v)
          WHEN 2 THEN CASE WHEN r <= 0 THEN NULL WHEN r >= 3600 THEN printf('%dh%02d', r // 3600, r // 60 % 60) ELSE printf('%dmin', r // 60) END END AS menu,
        CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 4 > 0 AND p > 0 THEN printf('%d%% · +%d%%', l, p) ELSE printf(' %d%%', l) END END AS title,
        CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Resets ' || strftime(ts, '%H:%M') ELSE 'Resets in ' || CASE WHEN c >= 1440 AND c // 60 % 24 > 0 THEN printf('%dd %dh', c // 1440, c // 60 % 24)
          WHEN c >= 1440 THEN printf('%dd', c // 1440) WHEN c >= 60 AND c % 60 > 0 THEN printf('%dh %dm', c // 60, c % 60) WHEN c >= 60 THEN printf('%dh', c // 60) ELSE printf('%dm', c) END END END AS resets,
        CASE WHEN event_id % 2 = 0 THEN printf('%d%% used', least(100, v)) ELSE printf('%d%% left', 100 - least(100, v)) END AS percent,
        CASE WHEN event_id % 7 = 0 THEN '—' ELSE coalesce(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][event_id % 9 + 1], CAST(event_id % 9 AS VARCHAR)) || printf(' · $%d.50', v) END AS busiest FROM s""",
)
_add(
    "staleness", "events", lambda: ["event_id", stale().alias("stale"), fn.is_critical(stale(), broken(), 100 - value(), F.when(e_id() % 2 == 0, k())).alias("critical")],
    """SELECT event_id, stale, NOT stale AND event_type <> 'error' AND (100 - value <= 10 OR (event_id % 2 = 0 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 10)) AS critical
      FROM (SELECT *, event_type = 'error' OR epoch_us(TIMESTAMP '2024-01-30 23:59:00') - epoch_us(ts) > 300000000 AS stale FROM events)""",
)
_add(
    "return_on_plan", "events", lambda: ["event_id", fn.roi_multiplier(value() * 10, F.when(e_id() % 3 == 0, 200.0).when(e_id() % 3 == 1, 20.0)).alias("multiplier"), fn.cost_days(e_id() % 500 - 20).cast("long").alias("days")],
    """SELECT event_id, CASE WHEN event_id % 3 < 2 AND value > 0 THEN CAST(floor(value * 10 / CASE WHEN event_id % 3 = 0 THEN 200.0 ELSE 20.0 END + 0.5) AS BIGINT) END AS multiplier,
      greatest(1, least(365, event_id % 500 - 20)) AS days FROM events""",
)
