"""Case accounting in exact decimals and its roll-up per partner.

Totals are summed per case first (map-side combine) and rounded after the sum; the roll-up adds
the rounded case values and never goes back to raw entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import label
from folioscope.operators.spread import dealt, positions, repeated_keys

MONEY = "decimal(18,2)"

# Tax rate, category names and stage vocabulary of the business rules.
TAX_RATE = "0.075"
BANK_FEE_CATEGORY = "TAXAS BANCÁRIAS"
PAYOUT_CATEGORY = "HONORÁRIOS DE PARCEIROS"
FEE_MARK = "HONOR"
COURT_ORDER_CATEGORY = "RPVS"
KIND_ORDER = {"fee_income": 0, "bank_fee": 1, "partner_payout": 2}
KNOWN_STEPS = (
    "MARKETING",
    "NEGOCIAÇÃO",
    "CONSULTORIA",
    "ADMINISTRATIVO",
    "JUDICIAL",
    "RECURSAL",
    "EXECUÇÃO/COBRANÇA",
    "RH/FINANCEIRO",
    "ARQUIVAMENTO",
)
JUDICIAL_STEPS = ("JUDICIAL", "RECURSAL", "EXECUÇÃO/COBRANÇA")
COLLECTION_STEP = "EXECUÇÃO/COBRANÇA"
AWAITING_FEES = "AGUARDANDO PAGAMENTO DOS HONORÁRIOS"
FEES_SETTLED = "HONORÁRIOS QUITADOS"

ACCOUNT_FIELDS = (
    "paid_income",
    "bank_fees",
    "tax",
    "net",
    "partner_share",
    "partner_paid",
    "balance",
    "future_income",
    "partner_future",
    "office_revenue",
)


def classify_entry(entry_type: Column, category: Column) -> Column:
    """fee_income, bank_fee, partner_payout, or null for entries that must not be read."""
    side, name = label(entry_type), label(category)
    income = (side == "INCOME") & (name.contains(FEE_MARK) | (name == COURT_ORDER_CATEGORY))
    return (
        F.when(income, "fee_income")
        .when((side == "EXPENSE") & (name == BANK_FEE_CATEGORY), "bank_fee")
        .when((side == "EXPENSE") & (name == PAYOUT_CATEGORY), "partner_payout")
    )


def classified(transactions: DataFrame) -> DataFrame:
    """Entries with an accounting kind; all others are dropped at once."""
    kind = classify_entry(F.col("entry_type"), F.col("category"))
    return transactions.filter(F.col("case_id").isNotNull()).withColumn("kind", kind).filter("kind is not null")


def is_paid() -> Column:
    return F.col("date_payment").isNotNull() & F.col("amount").isNotNull()


def case_totals(entries: DataFrame) -> DataFrame:
    """Sums per case that the account formula needs, and the number of classified entries."""
    def total(kind: str, paid: bool) -> Column:
        wanted = (F.col("kind") == kind) & F.col("amount").isNotNull() & (is_paid() == F.lit(paid))
        return F.coalesce(F.sum(F.when(wanted, F.col("amount"))), F.lit(0)).cast(MONEY)

    return entries.groupBy("case_id").agg(
        total("fee_income", True).alias("paid_income"),
        total("bank_fee", True).alias("bank_fees"),
        total("partner_payout", True).alias("partner_paid"),
        total("fee_income", False).alias("future_income"),
        F.count(F.lit(1)).alias("entries"),
    )


def checked_percentage(percentage: Column) -> Column:
    return F.when(percentage.between(0, 100), percentage).otherwise(
        F.raise_error(F.lit("partner percentage outside 0..100")).cast("decimal(5,2)")
    )


def account_cases(cases: DataFrame, entries: DataFrame, partners: DataFrame) -> DataFrame:
    """Statement per (partner_id, case_id); a case without entries has zero totals."""
    rated = cases.select("partner_id", "case_id").join(
        partners.select("partner_id", checked_percentage(F.col("percentage")).alias("percentage")), "partner_id"
    )
    raw = ("paid_income", "bank_fees", "partner_paid", "future_income")
    joined = rated.join(case_totals(entries), "case_id", "left")
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in raw}
        | {"entries": F.coalesce(F.col("entries"), F.lit(0).cast("bigint"))}
    )
    tax_rate = F.lit(TAX_RATE).cast("decimal(4,3)")
    rate = (F.col("percentage") / F.lit(100).cast("decimal(3,0)")).cast("decimal(9,4)")
    cents = lambda value: F.round(value, 2).cast(MONEY)
    untaxed = (F.lit(1).cast("decimal(1,0)") - tax_rate).cast("decimal(4,3)")
    return (
        filled.withColumn("tax", cents(F.col("paid_income") * tax_rate))
        .withColumn("net", (F.col("paid_income") - F.col("bank_fees") - F.col("tax")).cast(MONEY))
        .withColumn("partner_share", cents(F.col("net") * rate))
        .withColumn("balance", (F.col("partner_share") - F.col("partner_paid")).cast(MONEY))
        .withColumn("partner_future", cents(F.col("future_income") * (untaxed * rate).cast("decimal(14,7)")))
        .withColumn("office_revenue", (F.col("net") - F.col("partner_share")).cast(MONEY))
        .select("partner_id", "case_id", "entries", *ACCOUNT_FIELDS)
    )


def statement_lines(entries: DataFrame) -> DataFrame:
    """Entries with their line number inside the case statement.

    Ordered by payment day, else due day, else last; on one day income comes before its fee and
    the payout, then the order of the source id decides.
    """
    day = F.coalesce("date_payment", "date_due", F.to_date(F.lit("9999-12-31")))
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in KIND_ORDER.items()])
    ranked = entries.withColumn("_day", day).withColumn("_kind", rank)
    return positions(ranked, ["case_id"], "entry_id", "line", [("_day", "_kind")]).drop("_day", "_kind")


def finance_summary(accounts: DataFrame) -> DataFrame:
    """Roll-up per partner over already rounded case values."""
    fields = ("paid_income", "partner_share", "partner_paid", "balance", "partner_future", "office_revenue")
    return accounts.groupBy("partner_id").agg(
        F.count_if(F.col("entries") > 0).alias("cases_with_finance"),
        *[F.sum(f).cast(MONEY).alias(f) for f in fields],
    )


def classify_stage(cases: DataFrame) -> DataFrame:
    """Adds the overlapping flags known, judicial, benefit and awaiting_fees."""
    step, stage = label(F.col("step")), label(F.col("stage"))
    return cases.withColumns(
        {
            "known": step.isin(*KNOWN_STEPS),
            "judicial": step.isin(*JUDICIAL_STEPS),
            "benefit": (step == COLLECTION_STEP) | stage.isin(AWAITING_FEES, FEES_SETTLED),
            "awaiting_fees": stage == AWAITING_FEES,
        }
    )


def in_financial() -> Column:
    return F.col("awaiting_fees") | (F.col("future_income") > 0)


def indicators(cases: DataFrame, case_customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Counts per partner; ``cases`` carries step and stage. Flags overlap by design.

    Clients are counted on the bridge, apart from the case flags, so no case row is multiplied.
    """
    flagged = classify_stage(cases.select("case_id", "step", "stage"))
    flags = (
        accounts.select("partner_id", "case_id", "future_income")
        .join(flagged, "case_id")
        .groupBy("partner_id")
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.count_if("benefit").alias("benefit"),
            F.count_if(in_financial()).alias("financial"),
            F.count_if("judicial").alias("judicial"),
            F.count_if(~F.col("known")).alias("unclassified"),
        )
    )
    clients = (
        accounts.select("partner_id", "case_id")
        .join(case_customers, "case_id")
        .select("partner_id", "customer_id")
        .distinct()
        .groupBy("partner_id")
        .agg(F.count(F.lit(1)).alias("clients"))
    )
    return flags.join(clients, "partner_id", "left").withColumn(
        "clients", F.coalesce("clients", F.lit(0).cast("bigint"))
    )


def report_cases(
    eligible_cases: DataFrame,
    cases: DataFrame,
    case_customers: DataFrame,
    customers: DataFrame,
    latest_movements: DataFrame,
) -> DataFrame:
    """Case rows of every partner report, range-sorted by first customer name, folder and id.

    Names are read in customer-id order; the leading one is kept as an aggregate, while the full
    customer list stays relational (``case_customers``), so no case carries an unbounded array.
    """
    named = case_customers.join(
        customers.filter("name is not null and name <> ''").select("customer_id", "name"), "customer_id"
    )
    lead = named.groupBy("case_id").agg(
        F.min_by("name", "customer_id").alias("first_customer"), F.count(F.lit(1)).alias("named_customers")
    )
    return (
        eligible_cases.select("partner_id", "case_id")
        .join(classify_stage(cases), "case_id")
        .join(lead, "case_id", "left")
        .join(latest_movements.select("case_id", "last_movement_at", "last_movement_title"), "case_id", "left")
        .withColumn("named_customers", F.coalesce("named_customers", F.lit(0).cast("bigint")))
        .orderBy(
            "partner_id", F.lower(F.coalesce("first_customer", F.lit(""))), F.coalesce("folder", F.lit("")), "case_id"
        )
    )


def portfolio_enrichment(portfolio: DataFrame, movements: DataFrame, transactions: DataFrame) -> dict[str, DataFrame]:
    """Latest movement and classified entries of the portfolio's cases, with contract violations.

    ``foreign`` lists classified entries of other cases, ``repeated`` ids read more than once; the
    enrichment is valid only while both are empty.
    """
    from folioscope.operators.latest import latest_movement

    wanted = portfolio.select("case_id").distinct()
    of_portfolio = wanted.withColumn("_wanted", F.lit(True))
    # Joined, not semi-joined: Spark would move a semi-join under the dealing.
    kept = dealt(classified(transactions), "case_id")
    marked = kept.join(of_portfolio, "case_id", "left")
    return {
        "movements": latest_movement(movements, wanted),
        "entries": marked.filter("_wanted").drop("_wanted"),
        "foreign": marked.filter("_wanted is null").drop("_wanted"),
        "repeated": repeated_keys(marked.filter("_wanted"), ["entry_id"]),
    }
