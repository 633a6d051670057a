"""Folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names; a temporary one where that is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not re.match(r"local(\[.*)?$", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="usageloom-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in that folder: for results that are read more than once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
