"""Queries over usage rows, for the period of DAYS days up to NOW; the `events` table stands in for activity logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.operators import aggregates as agg
from usageloom.operators import dashboard as dash
from usageloom.operators.clean import clean_usage, in_window, keep_last, priced
from usageloom.operators.fold import folded
from usageloom.sources.folders import stored
from usageloom.sources.usage import usage_of_events

NOW, DAYS = dt.datetime(2024, 1, 30, 18), 30
TODAY = NOW.date()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(spark: SparkSession, sf_dir: str, days: int = DAYS, cached_too: bool = True) -> DataFrame:
    return priced(clean_usage(usage_of_events(load(spark, sf_dir, "events")), TODAY, days, cached_too))


def usage_sql(days: int = DAYS, cached_too: bool = True) -> str:
    """CTEs: usage (all rows), clean (filtered, deduplicated), rows (with cost and volume)."""
    some = "input_tokens > 0 OR output_tokens > 0" + " OR cache_read > 0 OR cache_write > 0" * cached_too
    return f"""
    ev AS (SELECT *, greatest(CAST(trunc(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS BIGINT), 0) AS k FROM events),
    usage AS (
      SELECT 'f' || (user_id % 7) AS file, event_id, ts, CAST(ts AS DATE) AS day, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
        CASE event_type WHEN 'click' THEN 'claude-opus-4' WHEN 'view' THEN 'claude-sonnet-4' WHEN 'purchase' THEN 'claude-3-5-sonnet'
          WHEN 'signup' THEN 'claude-haiku-3-5' ELSE 'event-' || event_type END AS model,
        'p' || (user_id % 12) AS project, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
        CASE WHEN event_id % 10 <> 0 THEN user_id || ':' || strftime(ts, '%Y-%m-%d %H') END AS message_key,
        k AS input_tokens, greatest(CAST(floor(coalesce(value, 0)) AS BIGINT), 0) AS output_tokens,
        CASE WHEN event_id % 3 = 0 THEN 10 * k ELSE 0 END AS cache_read, CASE WHEN event_id % 7 = 0 THEN k ELSE 0 END AS cache_write
      FROM ev),
    fit AS (SELECT * FROM usage WHERE ({some}) AND day BETWEEN DATE '{TODAY}' - {days - 1} AND DATE '{TODAY}'),
    clean AS (
      SELECT * FROM fit WHERE message_key IS NULL
      UNION ALL
      SELECT * FROM fit WHERE message_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, message_key ORDER BY event_id DESC) = 1),
    prices(model, pin, pout) AS (VALUES ('claude-opus-4', 1.5e-5, 7.5e-5), ('claude-sonnet-4', 3e-6, 1.5e-5), ('claude-3-5-sonnet', 3e-6, 1.5e-5), ('claude-haiku-3-5', 8e-7, 4e-6)),
    rows AS (
      SELECT c.*, input_tokens * coalesce(pin, 3e-6) + output_tokens * coalesce(pout, 1.5e-5) AS cost,
        input_tokens + output_tokens + cache_read + cache_write AS volume
      FROM clean c LEFT JOIN prices USING (model))"""


COST = "round(coalesce(sum(cost), 0), 9)"


def _total(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS BIGINT)"


SUMS = ", ".join(f"{_total(c)} AS {c}" for c in ("input_tokens", "output_tokens", "cache_read", "cache_write"))
BY_DAY = f"bdm AS (SELECT day, model, {SUMS}, {COST} AS cost FROM rows GROUP BY day, model)"


def axis_sql(days: int = DAYS) -> str:
    return f"""{BY_DAY},
    days AS (SELECT DATE '{TODAY}' - CAST({days - 1} - i AS INTEGER) AS day FROM range({days}) t(i)),
    per_day AS (SELECT day, {SUMS}, {COST} AS cost FROM bdm GROUP BY day),
    axis AS (
      SELECT day, coalesce(cost, 0.0) AS cost, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
        coalesce(cache_read, 0) AS cache_read, coalesce(cache_write, 0) AS cache_write, coalesce(input_tokens + output_tokens, 0) AS tokens,
        coalesce(input_tokens + output_tokens + cache_read + cache_write, 0) AS volume
      FROM days LEFT JOIN per_day USING (day))"""


MODELS = f"models AS (SELECT model, {_total('input_tokens')} AS input_tokens, {_total('output_tokens')} AS output_tokens, {COST} AS cost FROM bdm GROUP BY model)"
VOLUMES = f"vols AS (SELECT day, model, {_total('input_tokens + output_tokens + cache_read + cache_write')} AS volume FROM bdm GROUP BY day, model)"
HEAT = f"""heat AS (
      SELECT CAST(w AS INTEGER) AS weekday, CAST(h AS INTEGER) AS hour, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens
      FROM range(7) a(w) CROSS JOIN range(24) b(h) LEFT JOIN (SELECT weekday, hour, {_total('volume')} AS tokens FROM rows GROUP BY weekday, hour) s ON s.weekday = w AND s.hour = h)"""
WINDOWS = f"""windows AS (
      SELECT {COST[:-1].replace('sum(cost)', f"sum(cost) FILTER (WHERE day = DATE '{TODAY}')")}) AS today_cost,
        CAST(coalesce(sum(tokens) FILTER (WHERE day = DATE '{TODAY}'), 0) AS BIGINT) AS today_tokens,
        round(coalesce(sum(cost) FILTER (WHERE day > DATE '{TODAY}' - 7), 0), 9) AS week_cost,
        CAST(coalesce(sum(tokens) FILTER (WHERE day > DATE '{TODAY}' - 7), 0) AS BIGINT) AS week_tokens,
        {COST} AS period_cost, {_total('tokens')} AS period_tokens, {_total('volume')} AS period_volume, count(*) AS span, min(day) AS first_day, max(day) AS last_day
      FROM axis),
    averaged AS (SELECT *, round(period_cost / span, 9) AS average_cost, CAST(floor(period_tokens / span) AS BIGINT) AS average_tokens FROM windows)"""


def _add(name: str, query: Query, sql: str, *ctes: str, days: int = DAYS, cached_too: bool = True) -> None:
    QUERIES[name] = query
    ORACLE[name] = f"WITH {', '.join([usage_sql(days, cached_too), *ctes])} {sql}"


def _of_rows(fn: Callable[[DataFrame], DataFrame], **how) -> Query:
    return lambda spark, sf_dir: fn(rows(spark, sf_dir, **how))


def _of_axis(fn: Callable[[DataFrame], DataFrame], days: int = DAYS) -> Query:
    return _of_rows(lambda r: fn(dash.daily_axis(agg.by_day_model(r), TODAY, days)), days=days)


def _of_models(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _of_rows(lambda r: fn(dash.by_model(agg.by_day_model(r))))


def _of_windows(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _of_axis(lambda a: fn(dash.period_windows(a, TODAY)))


ROLLUP = f"SELECT day, model, {_total('input_tokens')} AS input_tokens, {_total('output_tokens')} AS output_tokens, {COST} AS cost FROM rows GROUP BY day, model"

_add("by_day_model", _of_rows(agg.by_day_model), "SELECT * FROM bdm", BY_DAY)
_add("by_day_model_7d", _of_rows(agg.by_day_model, days=7), "SELECT * FROM bdm", BY_DAY, days=7)
_add("cost_rollup", _of_rows(lambda r: agg.cost_rollup(agg.cost_partials(r)), cached_too=False), ROLLUP, cached_too=False)
_add(
    "cost_summary", _of_rows(lambda r: agg.cost_summary(r, TODAY), cached_too=False),
    f"""SELECT round(coalesce(sum(cost) FILTER (WHERE day = DATE '{TODAY}'), 0), 9) AS today_cost, {COST} AS window_cost,
    CAST(coalesce(sum(input_tokens + output_tokens) FILTER (WHERE day = DATE '{TODAY}'), 0) AS BIGINT) AS today_tokens, {_total('input_tokens + output_tokens')} AS window_tokens FROM rows""",
    cached_too=False,
)
_add("by_project", _of_rows(agg.by_project), f"SELECT project, {COST} AS cost, {_total('volume')} AS tokens FROM rows GROUP BY project")
_add("heatmap_dense", _of_rows(agg.heatmap), "SELECT * FROM heat", HEAT)

SESSIONS = f"""per AS (SELECT session_id, model, {COST} AS cost FROM rows GROUP BY session_id, model),
    dominant AS (SELECT session_id, model FROM per QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY cost DESC, model) = 1),
    firsts AS (SELECT session_id, ts, project FROM rows QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1),
    sums AS (SELECT session_id, {_total('volume')} AS tokens, {COST} AS cost FROM rows GROUP BY session_id),
    sessions AS (SELECT s.session_id, f.ts AS started, f.project, d.model AS dominant_model, s.tokens, s.cost FROM sums s JOIN dominant d USING (session_id) JOIN firsts f USING (session_id))"""
_add("session_rollup", _of_rows(agg.sessions), "SELECT * FROM sessions", SESSIONS)
_add("top_sessions", _of_rows(agg.top_sessions), "SELECT * FROM sessions ORDER BY cost DESC, started DESC, session_id LIMIT 10", SESSIONS)
MTD = f"mtd AS (SELECT round(coalesce(sum(cost) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{NOW}'), 0), 9) AS mtd_cost FROM rows)"
_add("mtd_cost", _of_rows(lambda r: agg.month_to_date(r, NOW)), "SELECT * FROM mtd", MTD)
_add("daily_axis", _of_axis(lambda a: a), "SELECT * FROM axis", axis_sql())
_add("daily_axis_90d", _of_axis(lambda a: a, 90), "SELECT * FROM axis", axis_sql(90), days=90)
_add("by_model", _of_models(lambda m: m), "SELECT * FROM models", BY_DAY, MODELS)
_add("by_day_by_model", _of_rows(lambda r: dash.by_day_by_model(agg.by_day_model(r))), "SELECT * FROM vols", BY_DAY, VOLUMES)
_add("period_windows", _of_windows(lambda w: w), "SELECT * FROM averaged", axis_sql(), WINDOWS)


def _projection(spark: SparkSession, sf_dir: str, days: int = DAYS) -> DataFrame:
    """One roll-up gives both the period's windows and the whole month so far, which a short period doesn't hold."""
    found = stored(agg.by_day_model(rows(spark, sf_dir, agg.month_window(NOW, days)), NOW), "by-day-model")
    in_period = found.where(in_window(F.col("day"), TODAY, days))
    mtd = found.agg(agg.total_cost("month_cost").alias("mtd_cost"))
    return dash.projection(mtd, dash.period_windows(dash.daily_axis(in_period, TODAY, days), TODAY), NOW)


PROJECTED = """SELECT mtd_cost, round(mtd_cost / 30 * 31, 9) AS projected_cost,
    CASE WHEN period_cost > 0 THEN CAST(round(period_volume / period_cost * round(mtd_cost / 30 * 31, 9)) AS BIGINT) ELSE 0 END AS projected_tokens FROM mtd, windows"""
_add(
    "projection_7d", lambda spark, sf_dir: _projection(spark, sf_dir, 7), PROJECTED,
    axis_sql(7).replace("FROM bdm GROUP BY day)", f"FROM bdm WHERE day > DATE '{TODAY}' - 7 GROUP BY day)"), WINDOWS, MTD,
)
_add("mtd_cost_7d", _of_rows(lambda r: agg.month_to_date(r, NOW), days=7), "SELECT * FROM mtd", MTD, days=7)
_add(
    "projection", _projection,
    PROJECTED, axis_sql(), WINDOWS, MTD,
)
_add(
    "cache_hit_rate", _of_axis(dash.cache_hit_rate),
    "SELECT CASE WHEN sum(input_tokens + cache_read) > 0 THEN round(sum(cache_read) / CAST(sum(input_tokens + cache_read) AS DOUBLE), 9) ELSE 0.0 END AS hit_rate FROM axis", axis_sql(),
)


def _savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.by_day_model(rows(spark, sf_dir))
    return dash.cache_savings(dash.daily_axis(found, TODAY, DAYS), dash.by_model(found))


_add(
    "cache_savings", _savings,
    """SELECT model AS dominant_model, round(coalesce((SELECT sum(cache_read) FROM axis), 0) * greatest(0, coalesce(pout, 1.5e-5) - 0.1 * coalesce(pin, 3e-6)), 9) AS savings
    FROM (SELECT model FROM models ORDER BY cost DESC, model LIMIT 1) LEFT JOIN prices USING (model)""",
    axis_sql(), MODELS,
)
_add("daily_delta", _of_windows(dash.daily_delta), "SELECT CASE WHEN today_tokens > 0 AND average_cost > 0 THEN round(today_cost / average_cost - 1, 6) END AS delta FROM averaged", axis_sql(), WINDOWS)
_add("peak_hour", _of_rows(lambda r: dash.peak_hour(agg.heatmap(r))), "SELECT hour AS peak_hour FROM heat GROUP BY hour ORDER BY sum(tokens) DESC, hour LIMIT 1", HEAT)
_add(
    "busiest_weekday", _of_axis(dash.busiest_weekday),
    f"SELECT CAST(dayofweek(day) AS INTEGER) AS weekday, {COST} AS cost FROM axis WHERE cost > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", axis_sql(),
)
_add("top_model", _of_rows(lambda r: dash.top_model(agg.by_day_model(r))), f"SELECT model, {_total('volume')} AS volume FROM vols GROUP BY model ORDER BY 2 DESC, 1 LIMIT 1", BY_DAY, VOLUMES)
_add(
    "model_topn_overflow", _of_models(dash.model_overflow),
    """SELECT CAST(rank AS INTEGER) AS rank, model, tokens, cost, round(cost / top, 9) AS bar, CAST(1 AS BIGINT) AS n_models FROM ranked WHERE rank <= 5
    UNION ALL SELECT 6, 'other', CAST(sum(tokens) AS BIGINT), round(sum(cost), 9), NULL, count(*) FROM ranked WHERE rank > 5 HAVING count(*) > 0""",
    BY_DAY, MODELS, "ranked AS (SELECT model, input_tokens + output_tokens AS tokens, cost, row_number() OVER (ORDER BY cost DESC, model) AS rank, max(cost) OVER () AS top FROM models)",
)
_add("model_share", _of_models(dash.model_share), "SELECT model, cost, round(cost / sum(cost) OVER (), 6) AS share, CAST(round(cost / sum(cost) OVER () * 100) AS INTEGER) AS percent FROM models", BY_DAY, MODELS)
_add("palette_index", _of_models(lambda m: dash.palette_index(m, 3)), "SELECT model, CAST((row_number() OVER (ORDER BY cost DESC, model) - 1) % 3 AS INTEGER) AS colour FROM models", BY_DAY, MODELS)
_add("tokens_unpivot", _of_axis(dash.tokens_long), "UNPIVOT (SELECT day, input_tokens, output_tokens, cache_read, cache_write FROM axis) ON input_tokens, output_tokens, cache_read, cache_write INTO NAME kind VALUE tokens", axis_sql())


def _lerp(a: int, b: int, c: int, name: str) -> str:
    return f"round(CASE WHEN level < 0.5 THEN {a} + ({b} - {a}) * level * 2 ELSE {b} + ({c} - {b}) * (level - 0.5) * 2 END / 255, 6) AS {name}"


_add(
    "heatmap_log_scale", _of_rows(lambda r: dash.heat_scale(agg.heatmap(r))),
    "SELECT weekday, hour, tokens, round(level, 6) AS level, " + ", ".join([_lerp(42, 204, 247, "red"), _lerp(26, 124, 220, "green"), _lerp(19, 94, 196, "blue")])
    + ", CAST(round(exp(ln(1 + most) / 2) - 1) AS BIGINT) AS middle FROM levels",
    HEAT,
    """scaled AS (SELECT *, coalesce(min(CASE WHEN tokens > 0 THEN tokens END) OVER (), 0) AS least, max(tokens) OVER () AS most FROM heat),
    levels AS (SELECT *, CASE WHEN most <= 0 OR tokens <= 0 THEN 0.0 WHEN most <= least THEN 1.0 ELSE greatest(0.0, least(1.0, (ln(1 + tokens) - ln(1 + least)) / (ln(1 + most) - ln(1 + least)))) END AS level FROM scaled)""",
)
_add("cumulative_cost", _of_axis(dash.cumulative_cost), "SELECT day, cost, round(sum(cost) OVER (ORDER BY day), 9) AS running_cost FROM axis", axis_sql())
BANDS = [0.0, 1.0, 3.0, 5.0, 1000000.0]
_add(
    "cumulative_band", _of_models(lambda m: dash.cost_band(m, BANDS)),
    f"""SELECT value, coalesce((SELECT model FROM running WHERE running >= value ORDER BY rank LIMIT 1), (SELECT model FROM running ORDER BY rank DESC LIMIT 1)) AS model
    FROM (VALUES {', '.join(f'(CAST({b} AS DOUBLE))' for b in BANDS)}) asked(value)""",
    BY_DAY, MODELS,
    "ranked AS (SELECT *, row_number() OVER (ORDER BY cost DESC, model) AS rank FROM models), running AS (SELECT model, rank, round(sum(cost) OVER (ORDER BY rank), 9) AS running FROM ranked)",
)
_add(
    "day_top_models", _of_rows(lambda r: dash.day_top_models(dash.by_day_by_model(agg.by_day_model(r)))),
    "SELECT day, CAST(rank AS INTEGER) AS rank, model, volume FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY volume DESC, model) AS rank FROM vols WHERE volume > 0) WHERE rank <= 6", BY_DAY, VOLUMES,
)
_add("day_lookup", _of_rows(lambda r: dash.day_models(dash.by_day_by_model(agg.by_day_model(r)), dt.date(2024, 1, 15))), "SELECT * FROM vols WHERE day = DATE '2024-01-15' AND volume > 0", BY_DAY, VOLUMES)
_add("axis_ticks", _of_axis(lambda a: dash.axis_ticks(a, DAYS)), f"SELECT day FROM axis WHERE (day - (DATE '{TODAY}' - {DAYS - 1})) % 4 = 0", axis_sql())
_add(
    "csv_rows", _of_axis(dash.csv_rows),
    "SELECT strftime(day, '%Y-%m-%d') AS date, printf('%.4f', ((CAST(round(cost * 1e9) AS BIGINT) + 50000) // 100000) / 1e4) AS cost_usd, input_tokens, output_tokens, cache_read AS cache_read_tokens, cache_write AS cache_write_tokens FROM axis", axis_sql(),
)
_add("is_empty", _of_rows(lambda r: dash.is_empty(agg.by_day_model(r))), "SELECT count(*) = 0 AS is_empty FROM bdm", BY_DAY)


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line item of each (order, number); ties by all other columns."""
    items = load(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return keep_last(items, keys, ["l_shipdate", *[c for c in items.columns if c not in (*keys, "l_shipdate")]])


QUERIES["dedup_keep_last"] = dedup_keep_last
ORACLE["dedup_keep_last"] = """SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
  l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1"""


def dashboard_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five results of one scan, put under each other: kind, key, tokens, cost."""
    found = folded(rows(spark, sf_dir), NOW)
    text = lambda *keys: F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    parts = [
        found["by_day_model"].select(F.lit("day_model").alias("kind"), text("day", "model").alias("key"), (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_write")).alias("tokens"), "cost"),
        found["by_project"].select(F.lit("project").alias("kind"), F.col("project").alias("key"), "tokens", "cost"),
        found["heatmap"].select(F.lit("hour").alias("kind"), text("weekday", "hour").alias("key"), "tokens", F.lit(None).cast("double").alias("cost")),
        found["sessions"].select(F.lit("session").alias("kind"), text("session_id", "project", "dominant_model").alias("key"), "tokens", "cost"),
        found["month_to_date"].select(F.lit("month").alias("kind"), F.lit("").alias("key"), F.lit(None).cast("long").alias("tokens"), F.col("mtd_cost").alias("cost")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


_add(
    "dashboard_fold", dashboard_fold,
    f"""SELECT 'day_model' AS kind, day || '|' || model AS key, {_total('input_tokens + output_tokens + cache_read + cache_write')} AS tokens, round(sum(cost), 9) AS cost FROM bdm GROUP BY day, model
    UNION ALL SELECT 'project', project, {_total('volume')}, {COST} FROM rows GROUP BY project
    UNION ALL SELECT 'hour', weekday || '|' || hour, tokens, NULL FROM heat
    UNION ALL SELECT 'session', session_id || '|' || project || '|' || dominant_model, tokens, cost FROM sessions
    UNION ALL SELECT 'month', '', NULL, mtd_cost FROM mtd""",
    BY_DAY, HEAT, SESSIONS, MTD,
)
