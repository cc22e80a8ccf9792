"""Accounting queries."""

from pyspark.sql import functions as F

from folioscope.operators import finance
from folioscope.plans.registry import query
from folioscope.plans.steps import accounts, eligible_cases, entries, latest_movements


@query(
    "partner_statement",
    "partner_id l, name s, cases_with_finance l, paid_income m, partner_share m, partner_paid m, balance m, partner_future m, office_revenue m",
    """SELECT p.partner_id, p.name, count(*) FILTER (WHERE entries > 0) AS cases_with_finance, sum(paid_income) AS paid_income,
       sum(partner_share) AS partner_share, sum(partner_paid) AS partner_paid, sum(balance) AS balance,
       sum(partner_future) AS partner_future, sum(office_revenue) AS office_revenue
       FROM accounts a JOIN partners p USING (partner_id) GROUP BY ALL""",
)
def partner_statement(m):
    """What each partner earns over the cases that belong to no other partner."""
    return finance.finance_summary(accounts(m)).join(m.partners().select("partner_id", "name"), "partner_id")


@query(
    "f1_classify_entry",
    "entry_id l, case_id l, kind s",
    "SELECT entry_id, case_id, kind FROM entries",
)
def f1(m):
    return entries(m)


ACCOUNT_SHAPE = (
    "partner_id l, case_id l, entries l, paid_income m, bank_fees m, tax m, net m, partner_share m, partner_paid m, balance m, "
    "future_income m, partner_future m, office_revenue m"
)


@query("f2_account_case", ACCOUNT_SHAPE, "SELECT * FROM accounts")
def f2(m):
    return accounts(m)


@query(
    "f3_statement_lines",
    "case_id l, entry_id l, line l",
    """SELECT case_id, entry_id, row_number() OVER (PARTITION BY case_id ORDER BY
       coalesce(date_payment, date_due, DATE '9999-12-31'),
       CASE kind WHEN 'fee_income' THEN 0 WHEN 'bank_fee' THEN 1 ELSE 2 END, entry_id) AS line FROM entries""",
)
def f3(m):
    return finance.statement_lines(entries(m))


@query(
    "f4_finance_summary",
    "partner_id l, cases_with_finance l, paid_income m, partner_share m, partner_paid m, balance m, partner_future m, office_revenue m",
    """SELECT partner_id, count(*) FILTER (WHERE entries > 0) AS cases_with_finance, sum(paid_income) AS paid_income,
       sum(partner_share) AS partner_share, sum(partner_paid) AS partner_paid, sum(balance) AS balance,
       sum(partner_future) AS partner_future, sum(office_revenue) AS office_revenue FROM accounts GROUP BY partner_id""",
)
def f4(m):
    return finance.finance_summary(accounts(m))


@query(
    "f5_classify_stage",
    "case_id l, known b, judicial b, benefit b, awaiting_fees b",
    "SELECT * FROM stage_flags",
)
def f5(m):
    return finance.classify_stage(m.cases())


@query(
    "f6_indicators",
    "partner_id l, clients l, cases l, benefit l, financial l, judicial l, unclassified l",
    """SELECT partner_id, max(clients) AS clients, count(*) AS cases, count_if(benefit) AS benefit,
       count_if(awaiting_fees OR future_income > 0) AS financial, count_if(judicial) AS judicial,
       count_if(NOT known) AS unclassified
       FROM accounts JOIN stage_flags USING (case_id) JOIN (SELECT partner_id, count(DISTINCT customer_id) AS clients
         FROM eligible JOIN case_customers USING (case_id) GROUP BY 1) USING (partner_id) GROUP BY partner_id""",
)
def f6(m):
    return finance.indicators(m.cases(), m.case_customers(), accounts(m))


@query(
    "f7_in_financial",
    "case_id l, in_financial b",
    "SELECT case_id, awaiting_fees OR future_income > 0 AS in_financial FROM accounts JOIN stage_flags USING (case_id)",
)
def f7(m):
    staged = finance.classify_stage(m.cases()).select("case_id", "awaiting_fees")
    return accounts(m).join(staged, "case_id").withColumn("in_financial", finance.in_financial())


@query(
    "f8_report_cases",
    "partner_id l, case_id l, folder s, first_customer s, named_customers l, judicial b, last_movement_at t",
    """SELECT e.partner_id, e.case_id, c.folder, f.first_customer, coalesce(f.n, 0) AS named_customers, s.judicial,
       v.last_movement_at FROM eligible e JOIN cases c USING (case_id) JOIN stage_flags s USING (case_id)
       LEFT JOIN (SELECT case_id, min_by(name, customer_id) AS first_customer, count(*) AS n FROM case_customers
         JOIN customers USING (customer_id) WHERE name <> '' GROUP BY 1) f USING (case_id)
       LEFT JOIN latest_moves v USING (case_id)""",
)
def f8(m):
    return finance.report_cases(
        eligible_cases(m), m.cases(), m.case_customers(), m.customers(), latest_movements(m)
    )


@query(
    "f9_portfolio_enrichment",
    "part s, case_id l, entry_id l",
    """SELECT 'entry' AS part, case_id, entry_id FROM entries WHERE case_id IN (SELECT case_id FROM eligible)
       UNION ALL SELECT 'foreign', case_id, entry_id FROM entries WHERE case_id NOT IN (SELECT case_id FROM eligible)
       UNION ALL SELECT 'movement', case_id, 0 FROM movements JOIN eligible USING (case_id) GROUP BY case_id""",
)
def f9(m):
    parts = finance.portfolio_enrichment(eligible_cases(m), m.movements(), m.transactions())
    entry = parts["entries"].select(F.lit("entry").alias("part"), "case_id", "entry_id")
    foreign = parts["foreign"].select(F.lit("foreign").alias("part"), "case_id", "entry_id")
    moved = parts["movements"].select(F.lit("movement").alias("part"), "case_id", F.lit(0).alias("entry_id"))
    return entry.unionByName(foreign).unionByName(moved)
