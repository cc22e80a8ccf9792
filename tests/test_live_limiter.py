"""The live limiter under a session that names no state store of its own, as the driver's does."""

from folioscope.plans.all import QUERIES
from folioscope.session import STATE_STORE

DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_the_live_limiter_brings_its_state_store_along(spark, rows):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, DEFAULT_STORE)
    try:
        live = rows(QUERIES["st3_live_limiter"](spark, "/root/testdata/sf0.001"))
        assert spark.conf.get(STATE_STORE) == DEFAULT_STORE
    finally:
        spark.conf.set(STATE_STORE, before)
    assert live == rows(QUERIES["st3_failure_limiter"](spark, "/root/testdata/sf0.001"))
