"""Session settings the library expects; a cluster session may be passed in instead."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Number of tasks that local sessions deal texts out to.
SPREAD = "spark.tidemark.spread"


def local_session(app: str = "tidemark", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; cluster jobs bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config(SPREAD, str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_rocksdb_state(spark: SparkSession) -> None:
    """Timers and value state need the RocksDB provider; it is a per-session SQL setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
