"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split at run time, also where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above this size are not compiled by the JVM; wide projections then run
    # faster as several small methods.
    METHOD_LIMIT: "8000",
    # The state of streams outgrows a heap.
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "folioscope", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one that ``spark.checkpoint.dir`` names, else under the warehouse.

    The caller owns it and removes it when the result has been used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whatever store the session names.

    A stream takes its settings when it starts, so the session has its own back right after.
    """
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def small_methods(spark: SparkSession) -> None:
    """Wide projections become small methods from now on, whatever limit the session names.

    A frame takes the setting when it runs, so it stays; it changes no result.
    """
    if int(spark.conf.get(METHOD_LIMIT)) > int(SETTINGS[METHOD_LIMIT]):
        spark.conf.set(METHOD_LIMIT, SETTINGS[METHOD_LIMIT])
