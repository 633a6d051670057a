"""Model names and their prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families, longest prefix first, and USD per input and output token; an unknown model has the default's prices.
FAMILIES = ["claude-3-5-sonnet", "claude-haiku-3-5", "claude-sonnet-4", "claude-haiku-4", "claude-opus-4"]
PRICES = [
    ("claude-opus-4", 0.000015, 0.000075),
    ("claude-sonnet-4", 0.000003, 0.000015),
    ("claude-3-5-sonnet", 0.000003, 0.000015),
    ("claude-haiku-3-5", 0.0000008, 0.000004),
]
DEFAULT_MODEL = "claude-sonnet-4"
#: What a cached token costs, as a share of an input token's price.
CACHE_READ_SHARE = 0.1


def normal_model(raw: Column) -> Column:
    """Trimmed and lower-cased, without provider prefix and build date, collapsed to its family."""
    s = F.lower(F.btrim(raw, F.lit(" \t\n\x0b\x0c\r")))
    for prefix in ("anthropic.", "anthropic/"):
        s = F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 30)).otherwise(s)
    # A family is told by its start, with or without a date; only other names need the pattern.
    family = F.coalesce(*[F.when(s.startswith(f), F.lit(f)) for f in FAMILIES])
    return F.coalesce(family, F.regexp_replace(s, r"-\d{8}$", ""))


def display_name(model: Column) -> Column:
    return F.regexp_replace(model, "^claude-", "")


def price_table(spark: SparkSession) -> DataFrame:
    """The fixed prices, as a relation whose size the planner knows."""
    rows = ", ".join(f"('{model}', double({low!r}), double({high!r}))" for model, low, high in PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS prices(model, price_in, price_out)")


def default_price(prices: DataFrame | None = None) -> tuple[float, float]:
    """The default model's prices per input and output token: of a table, or else the fixed ones."""
    if prices is None:
        return next((low, high) for model, low, high in PRICES if model == DEFAULT_MODEL)
    found = prices.where(F.col("model") == DEFAULT_MODEL).select("price_in", "price_out").first()
    return (found[0], found[1]) if found else default_price()
