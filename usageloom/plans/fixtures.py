"""Queries over payloads, panels, headers and names that are made from every row of a table; their SQL computes the results anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions import formatting as fmt
from usageloom.functions import scalars as fn
from usageloom.plans.usage import Query, load
from usageloom.sources import payloads

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _id() -> Column:
    return F.col("event_id")


def _whole(column: Column) -> Column:
    return column.cast("bigint").cast("string")


def _choice(number: Column, texts: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number % len(texts) + 1).cast("int"))


def price_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue for each part: by provider, flat, of another family, or broken."""
    key = F.col("p_partkey")
    name = F.concat(F.lit("claude-m"), _whole(key % 40), F.lit("-"), F.lpad(_whole(key), 8, "0"))
    cost = F.concat(F.lit('{"cost": {"input": '), F.col("p_size").cast("string"), F.lit(', "output": "'), F.col("p_retailprice").cast("string"), F.lit('"}}'))
    nested = F.concat(F.lit('{"anthropic": {"models": {"'), name, F.lit('": '), cost, F.lit("}}}"))
    flat = F.concat(F.lit('{"'), name, F.lit('": '), cost, F.lit("}"))
    other = F.concat(F.lit('{"other": {"models": {"some-model": '), cost, F.lit("}}}"))
    text = F.when(key % 4 == 0, nested).when(key % 4 == 1, flat).when(key % 4 == 2, other).otherwise("{broken")
    found = payloads.price_catalog(load(spark, sf_dir, "part").select(text.alias("value")))
    return found.select("model", *[F.round(c, 12).alias(c) for c in ("price_in", "price_out")])


QUERIES["price_catalog"] = price_catalog
ORACLE["price_catalog"] = """SELECT 'claude-m' || (p_partkey % 40) AS model, round(p_size / 1e6, 12) AS price_in, round(p_retailprice / 1e6, 12) AS price_out FROM part
  WHERE p_partkey % 4 < 2 QUALIFY row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey % 4 = 0, lpad(CAST(p_partkey AS VARCHAR), 8, '0')) = 1"""


def payload_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate payload for each event, with the windows that its number calls for."""
    used = lambda name, n: F.concat(F.lit(f'"{name}": {{"utilization": '), (F.col("value") / n).cast("string"), F.lit(', "resets_at": "2025-12-25T12:00:00.000Z"}'))
    parts = F.concat_ws(
        ", ",
        F.when(_id() % 2 == 0, used("five_hour", 1)), F.when(_id() % 3 == 0, used("seven_day", 2)), F.when(_id() % 5 == 0, used("seven_day_sonnet", 4)),
        F.when(_id() % 7 == 0, '"cowork": {"utilization": 7}').when(_id() % 7 == 1, '"seven_day_routines": null'),
        F.when(_id() % 11 == 0, F.concat(F.lit('"extra_usage": {"is_enabled": true, "monthly_limit": '), _whole(_id() % 1000), F.lit(', "used_credits": 520, "currency": "usd"}'))),
    )
    text = F.when(_id() % 13 == 12, "no json").otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    w = F.col("w")
    found = load(spark, sf_dir, "events").select("event_id", payloads.rate_windows(text).alias("w"))
    return found.select(
        "event_id", w.session.utilization.alias("session"), w.session.minutes.alias("session_minutes"), w.weekly.utilization.alias("weekly"), w.sonnet.utilization.alias("sonnet"),
        w.dailyRoutines.utilization.alias("daily"), w.extra_usage.monthly_limit.alias("monthly_limit"), w.extra_usage.used_credits.alias("used_credits"), w.extra_usage.currency.alias("currency"),
    )


QUERIES["payload_cascade"] = payload_cascade
ORACLE["payload_cascade"] = """WITH w AS (SELECT event_id, event_id % 13 < 12 AS ok, CASE WHEN event_id % 2 = 0 THEN value END AS five, CASE WHEN event_id % 3 = 0 THEN value / 2 END AS seven,
    CASE WHEN event_id % 5 = 0 THEN value / 4 END AS son FROM events)
  SELECT event_id, CASE WHEN ok THEN coalesce(five, seven, son) END AS session, CASE WHEN ok AND coalesce(five, seven, son) IS NOT NULL THEN 300 END AS session_minutes,
    CASE WHEN ok THEN seven END AS weekly, CASE WHEN ok THEN son END AS sonnet, CASE WHEN ok AND event_id % 7 = 0 THEN 7.0::DOUBLE WHEN ok AND event_id % 7 = 1 THEN 0.0::DOUBLE END AS daily,
    CASE WHEN ok AND event_id % 11 = 0 THEN (event_id % 1000) / 100.0::DOUBLE END AS monthly_limit, CASE WHEN ok AND event_id % 11 = 0 THEN 5.2::DOUBLE END AS used_credits,
    CASE WHEN ok AND event_id % 11 = 0 THEN 'USD' END AS currency FROM w"""


def panel_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminal panel for each event, in one of six forms."""
    u, w = _whole(_id() % 101), _whole(_id() % 57)
    forms = [
        F.concat(F.lit("Current session\n"), u, F.lit("% used\nCurrent week (all models)\n"), w, F.lit("% used")),
        F.concat(F.lit("\x1b[1mCurrent session\x1b[0m\n\x1b[31m"), u, F.lit("%\x1b[0m used\nCurrent week\n"), w, F.lit(" % used")),
        F.concat(F.lit("Current session\n"), u, F.lit("% remaining\r\nCurrent week\n"), w, F.lit("% left")),
        F.concat(u, F.lit("% of this\n"), w, F.lit("% of that")),
        F.concat(F.lit("name | Opus 0% | default\nCurrent session: "), w, F.lit(".5% used")),
        F.lit("no figures here"),
    ]
    text = F.element_at(F.array(*forms), (_id() % 6 + 1).cast("int"))
    found = load(spark, sf_dir, "events").select("event_id", payloads.panel(text).alias("p"))
    return found.select("event_id", "p.session", "p.weekly")


QUERIES["panel_scrape"] = panel_scrape
ORACLE["panel_scrape"] = """SELECT event_id, CAST(CASE event_id % 6 WHEN 2 THEN 100 - event_id % 101 WHEN 4 THEN event_id % 57 + 0.5 WHEN 5 THEN NULL ELSE event_id % 101 END AS DOUBLE) AS session,
    CAST(CASE event_id % 6 WHEN 2 THEN 100 - event_id % 57 WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE event_id % 57 END AS DOUBLE) AS weekly FROM events"""


def release_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release feed for each event."""
    version = F.concat_ws(".", _whole(_id() % 3), _whole(_id() % 19), _whole(_id() % 7))
    asset = lambda name: F.concat(F.lit(f'{{"name": "{name}", "browser_download_url": "u/'), _whole(_id()), F.lit(f'/{name}"}}'))
    assets = F.when(_id() % 3 == 0, F.concat_ws(", ", asset("a.dmg"), asset("A.ZIP"))).when(_id() % 3 == 1, "").otherwise(F.concat_ws(", ", asset("b.zip"), asset("c.zip")))
    feed = F.concat(F.lit('{"tag_name": "'), F.when(_id() % 2 == 0, "v").otherwise(""), version, F.lit('", "assets": ['), assets, F.lit("]}"))
    r = payloads.release(F.when(_id() % 17 != 0, feed).otherwise("{"))
    return load(spark, sf_dir, "events").select("event_id", r.version.alias("version"), r.url.alias("url"))


QUERIES["release_feed"] = release_feed
ORACLE["release_feed"] = """SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN concat_ws('.', event_id % 3, event_id % 19, event_id % 7) END AS version,
    CASE WHEN event_id % 17 = 0 OR event_id % 3 = 1 THEN NULL ELSE 'u/' || event_id || CASE WHEN event_id % 3 = 0 THEN '/A.ZIP' ELSE '/b.zip' END END AS url FROM events"""


def plan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscription = _choice(_id(), ["Claude Max", "pro", "maximal", "Team plan", "", None])
    tier = _choice(_id(), ["x", "tier_team_5x", "default_claude_max_20x", "ENTERPRISE", None])
    plan = fn.plan_of(subscription, tier)
    return load(spark, sf_dir, "events").select("event_id", plan.alias("plan"), fn.plan_price(plan).alias("price"))


QUERIES["plan_names"] = plan_names
ORACLE["plan_names"] = """WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'max' WHEN 1 THEN 'pro' WHEN 3 THEN 'team' ELSE CASE event_id % 5 WHEN 1 THEN 'team' WHEN 2 THEN 'max' WHEN 3 THEN 'enterprise' END END AS plan FROM events)
  SELECT event_id, plan, CASE plan WHEN 'max' THEN 200.0::DOUBLE WHEN 'pro' THEN 20.0::DOUBLE END AS price FROM p"""


def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = load(spark, sf_dir, "events").select("event_id", (_id() * 7919 % 100003 * F.pow(F.lit(10.0), _id() % 6).cast("long")).alias("n"))
    return rows.select("event_id", fmt.count_text(n).alias("long_text"), fmt.short_count_text(n).alias("short_text"), fmt.compact_currency(n / 4).alias("money"), fmt.percent_text(n % 1000 / 1000).alias("percent"))


QUERIES["count_texts"] = count_texts
ORACLE["count_texts"] = """WITH c AS (SELECT event_id, event_id * 7919 % 100003 * CAST(pow(10, event_id % 6) AS BIGINT) AS n FROM events),
    t AS (SELECT *, (n + 50) // 100 AS k, (n + 50000) // 100000 AS m, (n + 50000000) // 100000000 AS b, (n + 200) // 400 AS q FROM c),
    s AS (SELECT *, CASE WHEN n < 1000000000 THEN printf('%d.%dM', m // 10, m % 10) ELSE printf('%d.%dB', b // 10, b % 10) END AS large FROM t)
  SELECT event_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%d.%dK', k // 10, k % 10) ELSE large END AS long_text,
    CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%dK', (n + 500) // 1000) ELSE large END AS short_text,
    CASE WHEN n >= 4000 THEN printf('$%d.%dK', q // 10, q % 10) ELSE printf('$%d.%02d', n // 4, n % 4 * 25) END AS money, printf('%d.%d%%', n % 1000 // 10, n % 10) AS percent FROM s"""


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    date = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(_id() % 4 == 0, _whole(_id() % 5000)).when(_id() % 4 == 1, F.concat(F.lit(" "), _whole(_id() % 100), F.lit(".5"))).when(_id() % 4 == 2, date).when(_id() % 8 == 3, "soon")
    return load(spark, sf_dir, "events").select("event_id", ((F.unix_micros(fn.retry_at(header, now)) - F.unix_micros(now)) / 1e6).alias("seconds"))


QUERIES["retry_after"] = retry_after
ORACLE["retry_after"] = """SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 5000 WHEN 1 THEN event_id % 100 + 0.5
    WHEN 2 THEN (epoch_us(date_trunc('second', ts)) - 1704067200000000) / 1000000 END AS DOUBLE) AS seconds FROM events"""
