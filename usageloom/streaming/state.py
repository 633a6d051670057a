"""Sessions for streams with keyed state."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings that a session of its own takes over from the one that it is made of.
KEPT = ["spark.sql.shuffle.partitions", "spark.sql.session.timeZone"]


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own, in which streams keep their state outside the JVM's heap, as transformWithState needs.

    Batches without data are off: a state with a time to live would ask for one after the other, and a run over what is there wouldn't end.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for name in KEPT:
        session.conf.set(name, spark.conf.get(name))
    return session
