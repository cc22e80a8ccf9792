"""Retention of sources, reports and audit events."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import months_before

# How long things are kept.
SOURCE_DAYS = 30
REPORT_MONTHS = 12
AUDIT_MONTHS = 24


def _at(now: dt.datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


def retention_plan(sources: DataFrame, batches: DataFrame, reports: DataFrame, audit: DataFrame, now: dt.datetime | str) -> DataFrame:
    """(kind, id) of everything that is due: sources, reports and audit events."""
    settled = batches.filter(
        F.col("state").isin("approved", "superseded") & (F.col("updated_at") <= _at(now) - F.make_dt_interval(F.lit(SOURCE_DAYS)))
    )
    due_sources = sources.filter("purged_at is null").join(settled.select("source_id").distinct(), "source_id", "left_semi")
    due_reports = reports.filter(
        F.col("purged_at").isNull()
        & (F.col("status") == "superseded")
        & (F.col("generated_at") <= months_before(_at(now), REPORT_MONTHS))
        & F.col("storage_key").isNotNull()
    )
    due_audit = audit.filter(F.col("occurred_at") <= months_before(_at(now), AUDIT_MONTHS))
    parts = (("source", due_sources, "source_id"), ("report", due_reports, "version_id"), ("audit", due_audit, "audit_id"))
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, df, key in parts],
    )


def retention_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def apply_retention(plan: DataFrame, sources: DataFrame, reports: DataFrame, audit: DataFrame, now: dt.datetime | str) -> dict[str, DataFrame]:
    """Planned sources and reports carry ``purged_at``, planned audit events are gone.

    Marked rows are never marked again, so a second run changes nothing.
    """
    def ids(kind: str, key: str) -> DataFrame:
        return plan.filter(F.col("kind") == kind).select(F.col("id").alias(key)).distinct()

    def marked(df: DataFrame, kind: str, key: str) -> DataFrame:
        due = ids(kind, key).withColumn("_due", F.lit(True))
        moment = F.when(F.col("purged_at").isNull() & F.col("_due"), _at(now)).otherwise(F.col("purged_at"))
        return df.join(due, key, "left").withColumn("purged_at", moment).drop("_due")

    return {
        "sources": marked(sources, "source", "source_id"),
        "reports": marked(reports, "report", "version_id"),
        "audit": audit.join(ids("audit", "audit_id"), "audit_id", "left_anti"),
    }


def expire(df: DataFrame, ts_col: str, before: dt.datetime | str, equal_stays: bool = True) -> DataFrame:
    """Rows that are still alive at ``before``; rows without a timestamp never end.

    Whether a row that ends exactly then stays is the caller's rule: sessions end, login windows stay.
    """
    ends = F.col(ts_col)
    alive = ends >= _at(before) if equal_stays else ends > _at(before)
    return df.filter(ends.isNull() | alive)
