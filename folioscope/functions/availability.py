"""Values that carry their availability state, source and moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five states.
STATES = ("available", "not_provided", "not_applicable", "pending_validation", "restricted")


def availability(
    value: Column,
    source: str,
    as_of: Column,
    validated_at: Column | None = None,
    missing_reason: str = "not_provided",
) -> Column:
    """struct(status, value, source, as_of, validated_at, reason); a null value is not_provided."""
    present = value.isNotNull()
    checked = validated_at if validated_at is not None else F.lit(None).cast("timestamp")
    return F.struct(
        F.when(present, F.lit("available")).otherwise(F.lit("not_provided")).alias("status"),
        value.alias("value"),
        F.lit(source).alias("source"),
        as_of.alias("as_of"),
        F.when(present, checked).alias("validated_at"),
        F.when(~present, F.lit(missing_reason)).alias("reason"),
    )


def gated(wrapped: Column, open_gate: Column, source: str, reason: str) -> Column:
    """The wrapped value while the gate is open, otherwise the same shape as pending."""
    def part(name: str, closed: Column) -> Column:
        return F.when(open_gate, wrapped[name]).otherwise(closed).alias(name)

    return F.struct(
        part("status", F.lit("pending_validation")),
        F.when(open_gate, wrapped["value"]).alias("value"),
        part("source", F.lit(source)),
        wrapped["as_of"].alias("as_of"),
        F.when(open_gate, wrapped["validated_at"]).alias("validated_at"),
        part("reason", F.lit(reason)),
    )


def money_value(amount: Column, currency: str = "BRL") -> Column:
    return F.struct(
        F.when(amount.isNull(), F.lit("not_provided")).otherwise(F.lit("available")).alias("status"),
        amount.cast("decimal(18,2)").alias("value"),
        F.lit(currency).alias("currency"),
    )


def is_consistent(wrapped: Column) -> Column:
    """A known state, and a value exactly when the state is available."""
    known = wrapped["status"].isin(*STATES)
    return known & ((wrapped["status"] == "available") == wrapped["value"].isNotNull())
