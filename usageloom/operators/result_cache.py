"""Results that are kept: by period and source listing, and a price catalogue that is good for a day."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.functions.models import price_table

#: Fixed value: for so long a fetched catalogue counts as fresh.
CATALOG_LIFE = dt.timedelta(hours=24)
log = logging.getLogger(__name__)


def fingerprint(spark: SparkSession, roots: Sequence[str], pattern: str = "*.jsonl") -> str:
    """A text that changes when a file below the roots comes, goes or changes; of the listing only, and summed by Spark."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.load(list(roots)).select("path", "length", "modificationTime")
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}".replace("--", "-m")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def cached_result(spark: SparkSession, store: str, period: str, roots: Sequence[str], build: Callable[[], DataFrame], pattern: str = "*.jsonl") -> DataFrame:
    """build()'s rows, stored for the period and the state of the sources: as long as neither changes they are only read.

    The fingerprint is taken before the sources are read, so a change meanwhile is seen the next time.
    """
    path = f"{store}/period={period}/{fingerprint(spark, roots, pattern)}"
    if (found := _read(spark, path)) is None:
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def kept_catalog(spark: SparkSession, store: str, fetch: Callable[[], DataFrame], now: dt.datetime) -> DataFrame:
    """Prices (model, price_in, price_out): those stored, if fetched within CATALOG_LIFE before now; else fetched and stored.

    If fetching fails or gives none, what is stored goes on counting whatever its age, and without that the fixed prices.
    Each fetch has a folder of its own, so that readers of the one before aren't disturbed.
    """
    kept = _read(spark, f"{store}/prices")
    last = kept.agg(F.max("fetched_at")).first()[0] if kept is not None else None
    stored = None if last is None else kept.where(F.col("fetched_at") == F.lit(str(last)).cast("timestamp_ntz")).select("model", "price_in", "price_out")
    if last is not None and now - last < CATALOG_LIFE:
        return stored
    try:
        fetched = fetch().select("model", "price_in", "price_out", F.lit(str(now)).cast("timestamp_ntz").alias("fetched_at"))
        fetched.write.mode("append").parquet(f"{store}/prices")
        found = spark.read.parquet(f"{store}/prices").where(F.col("fetched_at") == F.lit(str(now)).cast("timestamp_ntz"))
        if not found.isEmpty():
            return found.select("model", "price_in", "price_out")
    except OSError as e:
        log.info("prices can't be fetched: %s", e)
    return stored if stored is not None else price_table(spark)
