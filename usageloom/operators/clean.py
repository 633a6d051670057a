"""From usage rows to priced ones: filters, keep-last deduplication, and the price lookup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.functions.models import default_price, price_table
from usageloom.functions.scalars import volume

#: Prices that may be broadcast (some 10 MB).
MOST_PRICES = 100_000
TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_write"]


def in_window(day: Column, today: dt.date, days: int) -> Column:
    """The last `days` calendar days up to today; later days are out."""
    return day.between(F.lit(today - dt.timedelta(days=max(1, days) - 1)), F.lit(today))


def has_tokens(*names: str) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | (F.col(name) > 0)
    return found


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The last row by `order` for each value of the keys in each `within`; rows with a null key all stay.

    One pass, one shuffle, and tasks drop older rows before it; rows with a null key are each a group of their own.
    """
    unkeyed = F.lit(False)
    for k in keys:
        unkeyed = unkeyed | F.col(k).isNull()
    alone = rows.withColumn("alone_", F.when(unkeyed, F.monotonically_increasing_id()))
    newest = Window.partitionBy(*within, *keys, "alone_").orderBy(*[F.col(c).desc() for c in order])
    return alone.withColumn("rank_", F.row_number().over(newest)).where(F.col("rank_") == 1).drop("rank_", "alone_")


def priced(rows: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds cost and volume. A model without a price has the default model's; cached tokens cost nothing here.

    The fixed prices, and a table of up to MOST_PRICES rows, are broadcast: few models have all the rows, and a shuffle
    by model would put them into few tasks.
    """
    low, high = default_price(prices)
    small = prices is None or prices.limit(MOST_PRICES + 1).count() <= MOST_PRICES
    prices = price_table(rows.sparkSession) if prices is None else prices
    found = rows.join(F.broadcast(prices) if small else prices, "model", "left")
    cost = F.col("input_tokens") * F.coalesce("price_in", F.lit(low)) + F.col("output_tokens") * F.coalesce("price_out", F.lit(high))
    return found.select(*rows.columns, cost.alias("cost"), volume(*[F.col(c) for c in TOKENS]).alias("volume"))


def clean_usage(usage: DataFrame, today: dt.date, days: int, cached_too: bool = True) -> DataFrame:
    """The rows of the window that have tokens (cached ones count too, or don't), one a message and file: the last."""
    counted = TOKENS if cached_too else TOKENS[:2]
    kept = usage.where(has_tokens(*counted) & in_window(F.col("day"), today, days))
    return keep_last(kept, ["message_key"], ["offset"], within=["file"])
