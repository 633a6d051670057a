"""Parsers of JSON and text payloads, as column expressions: a price catalogue, rate windows, a terminal panel, a release feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.functions.models import normal_model
from usageloom.functions.scalars import clamp

_COST = "struct<input: string, output: string>"
_CATALOG = f"map<string, struct<models: map<string, struct<cost: {_COST}>>, cost: {_COST}>>"


def price_catalog(raw: DataFrame, text: str = "value") -> DataFrame:
    """Prices (model, price_in, price_out) in USD a token of catalogues by provider or flat ones, in USD a million tokens.

    Flat entries go before others, and of ids with the same normal name the lesser one counts. Only `claude` models are kept.
    """
    top = raw.select(F.explode(F.from_json(text, _CATALOG)).alias("id", "entry"))
    nested = top.select(F.explode("entry.models").alias("id", "model")).select("id", F.col("model.cost").alias("cost"), F.lit(1).alias("layout"))
    flat = top.select("id", F.col("entry.cost").alias("cost"), F.lit(0).alias("layout"))
    every = nested.unionByName(flat).select(
        normal_model(F.col("id")).alias("model"), "id", "layout", *[(F.trim(f"cost.{x}").try_cast("double") / 1e6).alias(f"price_{y}") for x, y in (("input", "in"), ("output", "out"))]
    )
    good = every.where(F.col("model").startswith("claude") & F.col("price_in").isNotNull() & F.col("price_out").isNotNull())
    first = F.min_by(F.struct("price_in", "price_out"), F.struct("layout", "id"))
    return good.groupBy("model").agg(first.alias("p")).select("model", "p.price_in", "p.price_out")


#: The names under which the daily window comes.
ROUTINES = ["seven_day_routines", "seven_day_claude_routines", "claude_routines", "routines", "routine", "seven_day_cowork", "cowork"]
_WINDOWS = ["five_hour", "seven_day", "seven_day_oauth_apps", "seven_day_opus", "seven_day_sonnet"]
_EXTRA = "struct<is_enabled: boolean, monthly_limit: double, used_credits: double, utilization: double, currency: string>"
_RATE = ", ".join(f"{w}: struct<utilization: double, resets_at: string>" for w in [*_WINDOWS, *ROUTINES]) + f", extra_usage: {_EXTRA}"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def rate_windows(payload: Column) -> Column:
    """struct of the windows (utilization, resets_at, minutes) and extra usage of a rate payload; null for no JSON object."""
    # Bound before its fields are named: else each of them parses the payload again.
    read = F.struct(F.from_json(payload, f"struct<{_RATE}>").alias("parsed"), F.json_object_keys(payload).alias("keys"))
    return _once(read, lambda r: _windows(r.parsed, r["keys"]))


def _windows(parsed: Column, keys: Column) -> Column:
    def window(source: Column, minutes: int) -> Column:
        return F.when(
            source.isNotNull(),
            F.struct(F.coalesce(source.utilization, F.lit(0.0)).alias("utilization"), source.resets_at.alias("resets_at"), F.lit(minutes).alias("minutes")),
        )

    session = F.coalesce(*[parsed[w] for w in ("five_hour", "seven_day", "seven_day_oauth_apps", "seven_day_sonnet", "seven_day_opus")])
    named = F.exists(keys, lambda k: k.isin(ROUTINES))
    idle = F.struct(F.lit(0.0).alias("utilization"), F.lit(None).cast("string").alias("resets_at"), F.lit(1440).alias("minutes"))
    daily = F.coalesce(window(F.coalesce(*[parsed[k] for k in ROUTINES]), 1440), F.when(named, idle))
    extra = parsed.extra_usage
    cents = lambda x: F.coalesce(x, F.lit(0.0)) / 100
    extra_usage = F.when(
        extra.isNotNull(),
        F.struct(
            F.coalesce(extra.is_enabled, F.lit(False)).alias("is_enabled"), cents(extra.monthly_limit).alias("monthly_limit"), cents(extra.used_credits).alias("used_credits"),
            extra.utilization.alias("utilization"), F.coalesce(F.nullif(F.upper(extra.currency), F.lit("")), F.lit("USD")).alias("currency"),
        ),
    )
    windows = F.struct(
        window(session, 300).alias("session"), window(parsed.seven_day, 10080).alias("weekly"), window(parsed.seven_day_sonnet, 10080).alias("sonnet"),
        window(parsed.seven_day_opus, 10080).alias("opus"), daily.alias("dailyRoutines"), extra_usage.alias("extra_usage"),
    )
    return F.when(keys.isNotNull(), windows)


#: Escape sequences, and the words that tell what a percentage means.
ANSI = [r"\x1B\[[0-9;?]*[A-Za-z]", r"\x1B\][^\x07]*\x07", r"\x1B[@-Z\\-_]"]
LEFT, METER = r"left|remaining|available", r"opus|sonnet|haiku|default"
PERCENT = r"([0-9]{1,3}(?:\.[0-9]+)?)\p{Zs}*%"
LOOK_AHEAD = 12


def without_ansi(text: Column) -> Column:
    for pattern in ANSI:
        text = F.regexp_replace(text, pattern, "")
    return text


def label_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]", "")


def line_percent(line: Column) -> Column:
    """The used share that a line tells; null for none, and for the status bar's context meter."""
    lowered = F.lower(line)
    found = clamp(F.nullif(F.regexp_extract(line, PERCENT, 1), F.lit("")).cast("double"))
    meter = line.contains("|") & lowered.rlike(METER)
    return F.when(~meter, F.when(lowered.rlike(LEFT), 100 - found).otherwise(found))


def panel(text: Column) -> Column:
    """struct<session, weekly> of a terminal panel: by label, else by position; null where no session share is found."""
    split = F.transform(F.split(without_ansi(text), r"\r\n|[\n\r\x0B\x0C\x85  ]", -1), lambda x: F.struct(label_form(x).alias("label"), line_percent(x).alias("share")))

    # Bound once: else each line's look ahead, and each use of a share, splits the panel again.
    told = _once(split, lambda lines: F.struct(_share(lines, "currentsession", 0).alias("session"), _share(lines, "currentweek", 1).alias("weekly")))
    return _once(told, lambda t: F.when(t.session.isNotNull(), F.struct(t.session.alias("session"), F.coalesce(t.weekly, F.lit(0.0)).alias("weekly"))))


def _share(lines: Column, label: str, place: int) -> Column:
    """The first share at or after a line with the label, else the one at the place among all."""
    ahead = F.transform(lines, lambda x, i: F.when(x.label.contains(label), F.get(F.filter(F.slice(lines, i + 1, LOOK_AHEAD), lambda y: y.share.isNotNull()), 0).share))
    shares = F.filter(F.transform(lines, lambda x: x.share), lambda s: s.isNotNull())
    return F.coalesce(F.get(F.filter(ahead, lambda s: s.isNotNull()), 0), F.get(shares, place))


def release(feed: Column) -> Column:
    """struct<version, url>: the tag without one leading v, and the first zip asset; null for no JSON."""
    parsed = F.from_json(feed, "tag_name string, assets array<struct<name: string, browser_download_url: string>>")
    asset = F.get(F.filter(parsed.assets, lambda a: F.lower(a["name"]).endswith(".zip")), 0)
    found = F.struct(F.regexp_replace(parsed.tag_name, "^v", "").alias("version"), asset.browser_download_url.alias("url"))
    return F.when(parsed.tag_name.isNotNull(), found)
