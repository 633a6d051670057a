"""All first-level results of a dashboard from one pass: grouping sets over rows that are scanned and deduplicated once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.operators.aggregates import _of_month, cells_of, sessions_of, token_sums, total, total_cost
from usageloom.sources.folders import stored

#: The kinds of rows of a fold, and the keys of each.
KINDS = {"day_model": ["day", "model"], "project": ["project"], "hour": ["weekday", "hour"], "session_model": ["session_id", "model"], "all": []}
KEYS = list(dict.fromkeys(k for keys in KINDS.values() for k in keys))


def fold(rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Rows (kind, the KEYS, token sums, volume, cost, month_cost, start, first_project): sums of priced rows for each kind.

    month_cost is the part of the cost of now's month up to now; start and first_project are those of the first row by time.
    Every row goes into the partial sums once a kind; what is shuffled are those sums.
    """
    place = F.struct("ts", "offset")
    sums = [*token_sums(), total("volume").alias("volume"), total_cost().alias("cost"), total_cost(F.when(_of_month(now), F.col("cost"))).alias("month_cost")]
    first = [F.min(place).alias("start"), F.min_by("its_project", place).alias("first_project")]
    # A key is null in the rows of kinds without it; which kind a row is of is told by the keys that were left out.
    told = F.grouping_id(*KEYS)
    left_out = {kind: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys) for kind, keys in KINDS.items()}
    kind = F.coalesce(*[F.when(told == n, F.lit(name)) for name, n in left_out.items()]).alias("kind")
    sets = [[F.col(k) for k in keys] for keys in KINDS.values()]
    return rows.withColumn("its_project", F.col("project")).groupingSets(sets, *KEYS).agg(kind, *sums, *first)


def folded(rows: DataFrame, now: dt.datetime) -> dict[str, DataFrame]:
    """The results by_day_model, by_project, heatmap, sessions and month_to_date, of one fold that is stored."""
    found = stored(fold(rows, now), "fold")
    of = lambda kind: found.where(F.col("kind") == kind)
    tokens = ["input_tokens", "output_tokens", "cache_read", "cache_write"]
    return {
        "by_day_model": of("day_model").select("day", "model", *tokens, "cost"),
        "by_project": of("project").select("project", "cost", F.col("volume").alias("tokens")),
        "heatmap": cells_of(of("hour").select("weekday", "hour", F.col("volume").alias("tokens"))),
        "sessions": sessions_of(of("session_model").select("session_id", "model", "start", F.col("first_project").alias("project"), F.col("volume").alias("tokens"), "cost")),
        "month_to_date": of("all").select(F.col("month_cost").alias("mtd_cost")),
    }
