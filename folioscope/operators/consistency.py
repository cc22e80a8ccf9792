"""Consistency rules of a report that leaves the house."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import codes

# Provenance and reference shapes an external report must have.
LINK_SOURCE = "governed_partner_mapping"
METADATA_SOURCE = "report_builder"
ORIGIN_SOURCE = "synchronization"
ORIGIN_VALUE = "normalized"
RULE_VERSION = "portfolio_snapshot_v1"
CUSTOMER_REFERENCE = r"^C-\d{3,}$"
CASE_REFERENCE = r"^L-\d{3,}$"
GOVERNED = ("partner", "summary", "unique_customers", "cases", "customer_list", "case_list")
UNAPPROVED = (
    "benefits_granted", "in_financial", "in_judicial", "by_stage", "by_legal_status", "by_area", "financial",
)


def consistency_violations(reports: DataFrame, references: DataFrame) -> DataFrame:
    """``violations`` per report_id.

    ``reports`` has one wrapped value (struct with status, value, source) per field; ``references``
    lists every anonymous reference of a report as (report_id, kind, reference), counted per
    report before the join.
    """
    shape = F.when(F.col("kind") == "customer", F.col("reference").rlike(CUSTOMER_REFERENCE)).otherwise(
        F.col("reference").rlike(CASE_REFERENCE)
    )
    counted = references.groupBy("report_id").agg(
        F.count_if(F.col("kind") == "customer").alias("_customers"),
        F.count_if(F.col("kind") == "case").alias("_cases"),
        F.count_if(~F.coalesce(shape, F.lit(False))).alias("_malformed"),
    )

    def ready(name: str) -> Column:
        return F.col(f"{name}.status") == "available"

    def any_of(conditions: list[Column]) -> Column:
        return F.coalesce(F.greatest(*[F.coalesce(c, F.lit(True)).cast("int") for c in conditions]) == 1, F.lit(True))

    zero = F.lit(0).cast("bigint")
    joined = reports.join(counted, "report_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("_customers", "_cases", "_malformed")}
    )
    rules = {
        "required_unavailable": any_of([~ready(n) for n in GOVERNED]),
        "origin": any_of(
            [F.col("origin.value") != ORIGIN_VALUE, F.col("origin.source") != ORIGIN_SOURCE]
        ),
        "metadata": any_of(
            [F.col("metadata.value") != RULE_VERSION, F.col("metadata.source") != METADATA_SOURCE]
        ),
        "portfolio_source": any_of([F.col(f"{n}.source") != LINK_SOURCE for n in GOVERNED]),
        "counts": any_of(
            [F.col("unique_customers.value") != F.col("_customers"), F.col("cases.value") != F.col("_cases")]
        ),
        "unapproved_available": any_of([ready(n) for n in UNAPPROVED]),
        "reference_shape": F.col("_malformed") > 0,
    }
    violations = codes(*[F.when(rule, name) for name, rule in rules.items()])
    return joined.select("report_id", violations.alias("violations"))
