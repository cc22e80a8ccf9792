"""Steps that several queries share, over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioscope.operators import finance, latest, links
from folioscope.sources.sample import Model

LINK_DAY = "1998-01-01"
AS_OF = "2024-01-20 00:00:00"


def active_links(m: Model) -> DataFrame:
    return links.effective_on(m.links(), LINK_DAY)


def eligible_cases(m: Model) -> DataFrame:
    return links.eligible_cases(m.cases(), m.case_customers(), m.customers(), m.links(), LINK_DAY)


def entries(m: Model) -> DataFrame:
    return finance.classified(m.transactions())


def accounts(m: Model) -> DataFrame:
    return finance.account_cases(eligible_cases(m), entries(m), m.partners())


def latest_movements(m: Model) -> DataFrame:
    return latest.latest_movement(m.movements(), m.cases(), AS_OF)


def quality(m: Model, day: str = LINK_DAY) -> DataFrame:
    return links.portfolio_quality(
        m.partners(), m.cases(), m.case_customers(), m.customers(), m.links(), latest_movements(m), day
    )
