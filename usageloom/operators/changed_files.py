"""A result over many log files that reads only what has changed: partial sums by file, kept with the file's length and time.

Keep-last is by file, so a file's partial sums depend on that file alone, and their sum is what a whole scan gives. A run
lists the files, takes the stored partials of those that are as they were, and reads the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usageloom.operators.aggregates import token_sums, total_cost
from usageloom.operators.clean import TOKENS
from usageloom.sources.folders import stored
from usageloom.sources.lines import lines_of_files
from usageloom.streaming.partials import Partials

KEPT = f"path string, length long, time timestamp, run long, day date, model string, {', '.join(f'{c} long' for c in TOKENS)}, cost double"


def listing(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """Rows (path, length, time) of the files, none of which is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(roots))
    return files.select("path", "length", F.col("modificationTime").alias("time")).distinct()


def _latest(kept: DataFrame) -> DataFrame:
    """Of each file what the last run that read it has stored."""
    last = F.max("run").over(Window.partitionBy("path"))
    return kept.withColumn("last_", last).where(F.col("run") == F.col("last_")).drop("last_")


def changed_result(spark: SparkSession, store: str, roots: Sequence[str], usage: Callable[[DataFrame], DataFrame], pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(sums by day and model, the files that this run has read: path, length, time).

    usage makes of lines (file, offset, value) priced and deduplicated rows; it must always be the same for a store, so a
    window or zone of its own needs a store of its own. A file that is gone no longer counts.
    """
    partials = Partials(store, KEPT, _latest)
    there = stored(listing(spark, roots, pattern), "listing")
    kept = _latest(partials.read(spark))
    known = kept.select("path", "length", "time").distinct()
    same = ["path", "length", "time"]
    changed = stored(there.join(known, same, "left_anti"), "changed-files")
    if not changed.isEmpty():
        run = partials.next_number()
        sums = usage(lines_of_files(changed)).groupBy("file", "day", "model").agg(*token_sums(), total_cost().alias("cost"))
        # A file without rows has one, too, with a null day: it is known then.
        rows = changed.join(sums, F.col("path") == F.col("file"), "left").withColumn("run", F.lit(run).cast("long"))
        partials.put(rows.select(*[c.split()[0] for c in KEPT.split(", ")]), run)
    now = _latest(partials.read(spark)).join(there, same, "left_semi").where("day is not null")
    found = now.groupBy("day", "model").agg(*token_sums(), total_cost().alias("cost"))
    return found.orderBy(F.desc("cost"), F.desc("day"), "model"), changed
