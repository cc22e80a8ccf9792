"""Imports every query module, so that the registry is complete."""

from folioscope.plans import (  # noqa: F401
    coverage_queries,
    finance_queries,
    incremental_queries,
    ingest_queries,
    latest_queries,
    link_queries,
    reconcile_queries,
    status_queries,
    stream_queries,
)
from folioscope.plans.registry import QUERIES, SQL  # noqa: F401
