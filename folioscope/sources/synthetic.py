"""Generated portfolios for previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Customers and cases per scenario, and the rhythm of movements.
SCENARIOS = {"zero": (0, 0), "one": (1, 1), "many": (30, 55)}
AGE_CYCLE = 19
QUIET_CYCLE = 7


def synthetic_cases(portfolios: DataFrame) -> DataFrame:
    """Cases of each (partner_id, scenario): owner in turn, movement age in days or none."""
    size = F.create_map(*[F.lit(x) for name, (_, cases) in SCENARIOS.items() for x in (name, cases)])
    people = F.create_map(*[F.lit(x) for name, (persons, _) in SCENARIOS.items() for x in (name, persons)])
    cases = size[F.col("scenario")]
    numbered = portfolios.filter(cases > 0).withColumn("n", F.explode(F.sequence(F.lit(0), cases - 1)))
    first = F.col("partner_id") * 1000
    return numbered.select(
        "partner_id",
        "scenario",
        (first + F.col("n")).alias("case_id"),
        (first + F.col("n") % people[F.col("scenario")]).alias("customer_id"),
        F.when(F.col("n") % QUIET_CYCLE != 0, F.col("n") % AGE_CYCLE + 1).alias("movement_age"),
    )
