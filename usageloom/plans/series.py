"""Queries over sample series: each user of `events` is a rate window, and the value its utilization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions import formatting as fmt
from usageloom.operators import series as s
from usageloom.plans.usage import Query, load
from usageloom.sources.folders import scratch

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ORDER = ["ts", "event_id"]
THRESHOLDS = [50, 20]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    used = F.least(F.lit(100.0), F.col("value"))
    return events.select("event_id", "ts", "user_id", "event_type", used.alias("used"), (86400.0 * (F.col("user_id") % 7 + 1)).alias("until_reset"))


SAMPLES = "samples AS (SELECT event_id, ts, user_id, event_type, least(100.0, value) AS used, 86400.0 * (user_id % 7 + 1) AS until_reset FROM events)"
SECONDS = "(epoch_us(ts) - 1704067200000000) / 1e6"


def _add(name: str, query: Query, sql: str, *ctes: str) -> None:
    QUERIES[name] = query
    ORACLE[name] = f"WITH {', '.join([SAMPLES, *ctes])} {sql}"


AGED = "aged AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM samples)"
_add("rate_last20", lambda spark, d: s.last_n(samples(spark, d), "user_id", ORDER, s.HISTORY).select("user_id", "event_id", "age", "used"), "SELECT user_id, event_id, CAST(age AS INTEGER) AS age, used FROM aged WHERE age <= 20", AGED)


def recent_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 8 values, one a row, with their heights."""
    lines = s.sparkline(s.recent_values(samples(spark, sf_dir), "user_id", ORDER, "used", s.SPARK))
    return lines.select("user_id", F.posexplode(F.arrays_zip("values", "heights")).alias("place", "v")).select("user_id", "place", F.col("v.values").alias("used"), F.col("v.heights").alias("height"))


_add(
    "sparkline", recent_heights,
    """SELECT user_id, CAST(n - age AS INTEGER) AS place, used, CASE WHEN n <= 1 OR top <= 0 THEN 0.5 ELSE round(greatest(used, 0) / top, 6) END AS height
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, max(greatest(used, 0)) OVER (PARTITION BY user_id) AS top FROM aged WHERE age <= 8)""",
    AGED,
)
_add(
    "regression_slope",
    lambda spark, d: (lambda h: h.groupBy("user_id").agg(*s.slope(h, "user_id", "used")).select("user_id", "n_recent", F.round("slope", 12).alias("slope")))(s.last_n(samples(spark, d), "user_id", ORDER, s.RECENT)),
    f"SELECT user_id, count(used) AS n_recent, round(regr_slope(used, {SECONDS}), 12) AS slope FROM aged WHERE age <= 10 GROUP BY user_id", AGED,
)
LADDER = """CASE WHEN n < 3 OR slope IS NULL OR slope <= 0 OR (100 - used) / slope > until_reset THEN NULL ELSE round((100 - used) / slope / 60, 6) END AS minutes,
    CASE WHEN n < 3 OR slope IS NULL THEN 'calculating' WHEN slope <= 0 THEN 'stable' WHEN (100 - used) / slope > until_reset THEN 'low' WHEN n_recent >= 5 THEN 'high' ELSE 'low' END AS confidence"""


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.forecasts(samples(spark, sf_dir), "user_id", ORDER, "used", "until_reset")
    return found.select("user_id", "n", F.round("minutes", 6).alias("minutes"), "confidence")


_add(
    "forecast", forecast, f"SELECT user_id, n, {LADDER} FROM sums", AGED,
    f"""sums AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE age <= 10) AS n_recent, regr_slope(used, {SECONDS}) FILTER (WHERE age <= 10) AS slope,
      max(used) FILTER (WHERE age = 1) AS used, max(until_reset) FILTER (WHERE age = 1) AS until_reset FROM aged WHERE age <= 20 GROUP BY user_id)""",
)
RUNNING = f"""running AS (SELECT *, count(*) OVER (w ROWS 19 PRECEDING) AS n, count(*) OVER (w ROWS 9 PRECEDING) AS n_recent, regr_slope(used, {SECONDS}) OVER (w ROWS 9 PRECEDING) AS slope
      FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), told AS (SELECT *, {LADDER} FROM running)"""


def predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples at which the predictive alert fires."""
    told = s.running_forecasts(samples(spark, sf_dir), "user_id", ORDER, "used", "until_reset").withColumn("near", s.is_near(F.col("minutes")))
    told = s.previous(told, "user_id", ORDER, F.to_date("ts"), F.col("near"), "was_near")
    fired = told.where(s.predictive_alert(F.col("near"), F.col("was_near"), 100 - F.col("used")))
    return fired.select("event_id", "user_id", F.round("minutes", 6).alias("minutes"), "confidence")


_add(
    "predictive_alert", predictive,
    """SELECT event_id, user_id, minutes, confidence FROM (SELECT *, coalesce(minutes <= 30, false) AS near,
      lag(coalesce(minutes <= 30, false), 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM told) WHERE near AND NOT was AND 100 - used > 0.0001""",
    RUNNING,
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = samples(spark, sf_dir).withColumn("remaining", 100 - F.col("used"))
    return s.previous(left, "user_id", ORDER, F.to_date("ts"), F.col("remaining"))


def threshold_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = s.crossed_threshold(F.col("remaining"), F.col("previous"), F.array(*[F.lit(t) for t in THRESHOLDS]))
    return edges(spark, sf_dir).select("event_id", "user_id", "remaining", hit.alias("threshold")).where("threshold is not null")


def depleted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("event_id", "user_id", s.depletion_edge(F.col("remaining"), F.col("previous")).alias("edge")).where("edge is not null")


LAGGED = "lagged AS (SELECT *, 100 - used AS remaining, lag(100 - used) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM samples)"
_add(
    "threshold_cross", threshold_cross,
    """SELECT event_id, user_id, remaining, CAST(threshold AS INTEGER) AS threshold FROM (SELECT *, CASE WHEN remaining <= 20 AND (previous IS NULL OR previous > 20) THEN 20
      WHEN remaining <= 50 AND (previous IS NULL OR previous > 50) THEN 50 END AS threshold FROM lagged) WHERE threshold IS NOT NULL""", LAGGED,
)
_add(
    "depleted_edges", depleted_edges,
    """SELECT event_id, user_id, edge FROM (SELECT *, CASE WHEN remaining <= 0.0001 AND NOT coalesce(previous <= 0.0001, false) THEN 'depleted'
      WHEN remaining > 0.0001 AND coalesce(previous <= 0.0001, false) THEN 'restored' END AS edge FROM lagged) WHERE edge IS NOT NULL""", LAGGED,
)


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors keep the state of the last good sample."""
    good = F.col("event_type") != "error"
    state = F.when(good, F.struct("used", "event_id"))
    found = s.carried(samples(spark, sf_dir), "user_id", ORDER, F.to_date("ts"), state)
    return found.select("event_id", "user_id", (~good).alias("has_error"), F.col("carried.used").alias("used"), F.col("carried.event_id").alias("good_event"))


_add(
    "carry_forward", carry_forward,
    """SELECT event_id, user_id, event_type = 'error' AS has_error, last_value(CASE WHEN event_type <> 'error' THEN used END IGNORE NULLS) OVER w AS used,
      last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER w AS good_event
    FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
DIVISORS = {"session": 1, "weekly": 2, "sonnet": 3, "opus": 5, "dailyRoutines": 7}


def snapshot_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    windows = {w: F.when(id_ % n == 0, F.struct((F.col("used") / n).alias("utilization"), F.when(id_ % 4 != 0, (id_ % 1000 - 100) * n).alias("resets_in"))) for w, n in DIVISORS.items()}
    rows = s.fan_out(samples(spark, sf_dir).withColumns(windows), ["event_id"])
    return rows.select("event_id", "window_id", F.round("utilization", 6).alias("utilization"), "until_reset")


_add(
    "snapshot_fanout", snapshot_fanout,
    " UNION ALL ".join(
        f"SELECT event_id, '{w}' AS window_id, round(used / {n}, 6) AS utilization, CASE WHEN event_id % 4 <> 0 THEN greatest(0.0, CAST((event_id % 1000 - 100) * {n} AS DOUBLE)) ELSE CAST('inf' AS DOUBLE) END AS until_reset FROM samples WHERE event_id % {n} = 0"
        for w, n in DIVISORS.items()
    ),
)


def pace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    minutes = F.element_at(F.array(F.lit(300), F.lit(10080), F.lit(1440)), (id_ % 3 + 1).cast("int"))
    left = F.when(id_ % 11 != 0, (id_ * 3701 % (minutes * 70) - 600).cast("double"))
    p = samples(spark, sf_dir).select("event_id", s.pace(F.when(id_ % 13 == 0, 0.0).otherwise(F.col("used")), left, minutes).alias("p")).where("p is not null")
    return p.select("event_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("expected", "delta", "deficit", "reserve", "run_out_seconds")], "p.status", "p.lasts")


_add(
    "pace_status", pace_status,
    """SELECT event_id, round(expected, 6) AS expected, round(delta, 6) AS delta, round(greatest(delta, 0.0), 6) AS deficit, round(greatest(-delta, 0.0), 6) AS reserve,
      CASE WHEN NOT lasts THEN round(run_out, 6) END AS run_out_seconds, CASE WHEN abs(delta) <= 2 THEN 'onPace' WHEN delta > 0 THEN 'deficit' ELSE 'reserve' END AS status, lasts FROM ran""",
    """given AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 10080 ELSE 1440 END AS minutes, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE used END AS used FROM samples),
    timed AS (SELECT *, minutes * 60.0 AS span, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id * 3701 % (minutes * 70) - 600 AS DOUBLE) END AS remaining FROM given),
    paced AS (SELECT *, CAST(span - remaining AS DOUBLE) / CAST(span AS DOUBLE) * 100 AS expected, greatest(0.0, least(100.0, used)) AS actual FROM timed WHERE remaining > 0 AND remaining <= span),
    ran AS (SELECT *, actual - expected AS delta, CASE WHEN actual > 0 THEN (100 - actual) / actual * CAST(span - remaining AS DOUBLE) END AS run_out,
      CASE WHEN actual > 0 THEN (100 - actual) / actual * CAST(span - remaining AS DOUBLE) >= remaining ELSE true END AS lasts FROM paced WHERE expected >= 3)""",
)


def pace_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pace_status(spark, sf_dir)
    return p.select("event_id", fmt.pace_label(F.col("status"), F.col("delta"), F.col("expected")).alias("label"), fmt.run_out_label(F.col("lasts"), F.col("run_out_seconds")).alias("run_out"))


QUERIES["pace_labels"] = pace_labels
ORACLE["pace_labels"] = f"""WITH told AS ({ORACLE['pace_status']}), whole AS (SELECT *, CAST(floor(abs(delta) + 0.5) AS BIGINT) AS size, CAST(floor(run_out_seconds + 0.5) AS BIGINT) AS t FROM told)
  SELECT event_id, CASE status WHEN 'onPace' THEN 'On pace' WHEN 'deficit' THEN printf('%d%% in deficit', size) ELSE printf('%d%% in reserve', size) END || printf(' - %d%%', CAST(floor(expected + 0.5) AS BIGINT)) AS label,
    CASE WHEN lasts THEN 'Lasts until reset' WHEN run_out_seconds <= 0 THEN 'Runs out now' WHEN t < 60 THEN 'Runs out in now' WHEN t >= 86400 THEN printf('Runs out in %dd %dh', t // 86400, t % 86400 // 3600)
      WHEN t >= 3600 THEN printf('Runs out in %dh %dm', t // 3600, t % 3600 // 60) WHEN t IS NOT NULL THEN printf('Runs out in %dm', t // 60) END AS run_out FROM whole"""


def forecast_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a list of three windows' forecasts that of the one asked for, and whether it is shown."""
    id_ = F.col("event_id")
    minutes = lambda n: F.when(id_ % (n + 4) == 0, float("inf")).when(id_ % (n + 4) > 1, F.col("used") - n)
    every = F.array(*[F.struct(F.lit(w).alias("window_id"), minutes(n).alias("minutes")) for n, w in enumerate(("session", "weekly", "session"))])
    asked = F.element_at(F.array(*[F.lit(x) for x in ("session", "weekly", "opus")]), (id_ % 3 + 1).cast("int"))
    found = samples(spark, sf_dir).select("event_id", asked.alias("asked"), s.forecast_of(every, asked).minutes.alias("minutes"))
    mode = F.when(id_ % 5 < 2, "text").when(id_ % 5 < 4, "bar").otherwise("none")
    return found.select("event_id", "asked", "minutes", fmt.shows_forecast(mode, id_ % 2 == 0, F.col("minutes")).alias("shown"))


_add(
    "forecast_gate", forecast_gate,
    """SELECT event_id, asked, minutes, (event_id % 5 < 2 OR (event_id % 5 < 4 AND event_id % 2 = 1)) AND coalesce(minutes >= 0 AND minutes < CAST('inf' AS DOUBLE), false) AS shown FROM told""",
    """told AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'weekly' ELSE 'opus' END AS asked,
      CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 4 > 1 THEN used END
        WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 5 > 1 THEN used - 1 END END AS minutes FROM samples)""",
)


def alert_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that threshold and depletion edges post, with their ids."""
    before = edges(spark, sf_dir).withColumn("window_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    crossed = s.crossed_threshold(F.col("remaining"), F.col("previous"), F.array(*[F.lit(t) for t in THRESHOLDS])).cast("string")
    due = F.array_compact(F.array(crossed, s.depletion_edge(F.col("remaining"), F.col("previous"))))
    post = fmt.alert_post(F.col("window_id"), F.col("alert"), F.col("remaining"))
    return before.withColumn("alert", F.explode(due)).withColumn("post", post).select("event_id", F.col("post.id").alias("post_id"), F.col("post.body").alias("body"))


_add(
    "alert_posts", alert_posts,
    """SELECT event_id, 'threshold-u' || user_id || '-' || t AS post_id, printf('u%d at %d%% remaining', user_id, CAST(floor(greatest(remaining, 0) + 0.5) AS BIGINT)) AS body FROM
      (SELECT *, CASE WHEN remaining <= 20 AND (previous IS NULL OR previous > 20) THEN 20 WHEN remaining <= 50 AND (previous IS NULL OR previous > 50) THEN 50 END AS t FROM lagged) WHERE t IS NOT NULL
    UNION ALL SELECT event_id, e || '-u' || user_id, 'u' || user_id || CASE e WHEN 'depleted' THEN ' quota exhausted' ELSE ' quota restored' END FROM
      (SELECT *, CASE WHEN remaining <= 0.0001 AND NOT coalesce(previous <= 0.0001, false) THEN 'depleted' WHEN remaining > 0.0001 AND coalesce(previous <= 0.0001, false) THEN 'restored' END AS e FROM lagged) WHERE e IS NOT NULL""",
    LAGGED,
)


def sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history of each window after two runs, each of which adds what it has seen."""
    store, every = scratch(spark, "samples"), samples(spark, sf_dir).select("user_id", "ts", "event_id", "used")
    for half in (0, 1):
        s.add_samples(every.where(F.col("event_id") % 2 == half), "user_id", ORDER, store, half)
    return s.stored_samples(spark, store, 1).select("user_id", "event_id", "used")


_add("sample_store", sample_store, "SELECT user_id, event_id, used FROM aged WHERE age <= 20", AGED)


def hottest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, weekly = F.when(F.col("event_id") % 5 != 0, F.col("used")), F.when(F.col("event_id") % 3 != 0, F.col("used") * 1.5 - 10)
    return samples(spark, sf_dir).select("event_id", F.get(s.hottest_first(session, weekly), 0).alias("hottest"))


_add(
    "hottest_first", hottest_first,
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND used * 1.5 - 10 > CASE WHEN event_id % 5 <> 0 THEN used ELSE -1 END THEN 'weekly' ELSE 'session' END AS hottest FROM samples",
)


def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(x) for x in ("ok", "unavailable", "auth", "scope", "failed")])
    status = {n: F.element_at(states, (F.floor(F.col("event_id") / k) % 5 + 1).cast("int")) for n, k in (("oauth", 1), ("cli", 5), ("web", 25))}
    return samples(spark, sf_dir).select("event_id", s.chosen_source(status).alias("source"))


_add(
    "source_priority", source_priority,
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 0 THEN 'oauth' WHEN (event_id // 5) % 5 = 0 THEN 'cli' WHEN (event_id // 25) % 5 = 0 THEN 'web' END AS source FROM samples""",
)
