"""Helpers that the training-data operators share: tables in the folder that all executors see, and safe names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting of the bytes of an Arrow batch, its default, and what a worker gets here where that wasn't changed: what
#: the JVM and the worker hold of a batch is some times its size.
BATCH_SETTING, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH bytes, unless the session has a size of its own."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(DEFAULT_BATCH):
        spark.conf.set(BATCH_SETTING, str(BATCH))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs on this machine (tests), one is made and set."""
    small_batches(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not re.match(r"local(\[.*)?$", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="usageloom-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder: later reads don't compute it again and survive lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")
