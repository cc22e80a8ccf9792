"""Count-only summaries."""

from pyspark.sql import functions as F

from folioscope.operators import coverage, links
from folioscope.plans.registry import query
from folioscope.plans.steps import LINK_DAY

MAPPINGS = """(SELECT * FROM active_links WHERE partner_id IN (SELECT partner_id FROM partners WHERE status = 'active'))"""


@query(
    "a1_quality_summary",
    "partners_total l, partners_with_cases l, partners_without_cases l, linked l, unlinked l, conflicts l, missing_number l, "
    "customers_with_many_cases l, mappings_not_found l",
    f"""WITH maps AS {MAPPINGS},
       sets AS (SELECT k.case_id, l.partner_id FROM known_pairs k JOIN maps l ON l.entity_type = 'customer' AND l.entity_id = k.customer_id
         UNION SELECT c.case_id, l.partner_id FROM cases c JOIN maps l ON l.entity_type = 'case' AND l.entity_id = c.case_id),
       per_case AS (SELECT case_id, count(s.partner_id) AS n, min(s.partner_id) AS p FROM cases LEFT JOIN sets s USING (case_id) GROUP BY 1),
       live AS (SELECT partner_id FROM partners WHERE status = 'active')
       SELECT (SELECT count(*) FROM live) AS partners_total,
         (SELECT count(*) FROM live WHERE partner_id IN (SELECT p FROM per_case WHERE n = 1)) AS partners_with_cases,
         (SELECT count(*) FROM live WHERE partner_id NOT IN (SELECT p FROM per_case WHERE n = 1)) AS partners_without_cases,
         count_if(n = 1) AS linked, count_if(n = 0) AS unlinked, count_if(n > 1) AS conflicts,
         (SELECT count(*) FROM cases WHERE process_number IS NULL) AS missing_number,
         (SELECT count(*) FROM (SELECT 1 FROM case_customers GROUP BY customer_id HAVING count(*) > 1)) AS customers_with_many_cases,
         (SELECT count(*) FROM maps WHERE (entity_type = 'case' AND entity_id NOT IN (SELECT case_id FROM cases))
           OR (entity_type = 'customer' AND entity_id NOT IN (SELECT customer_id FROM customers))) AS mappings_not_found FROM per_case""",
)
def a1(m):
    live = m.partners().filter("status = 'active'")
    mappings = links.governed_mappings(m.partners(), m.links(), LINK_DAY)
    return coverage.quality_summary(live, m.customers(), m.cases(), m.case_customers(), mappings)


@query(
    "a2_movement_age",
    "age s, cases l",
    """SELECT CASE WHEN moved IS NULL THEN 'without_movement' WHEN d < 0 THEN 'future_dated' WHEN d <= 30 THEN '0_30_days'
         WHEN d <= 90 THEN '31_90_days' WHEN d <= 180 THEN '91_180_days' WHEN d <= 365 THEN '181_365_days' ELSE 'over_365_days' END AS age,
         count(*) AS cases FROM (SELECT moved, date_diff('day', moved, DATE '2024-01-20') AS d FROM cases LEFT JOIN
         (SELECT case_id, arg_max(occurred_on, (occurred_at, occurred_on)) - CAST(any_value(case_id) % 12 * 35 AS INTEGER) AS moved
          FROM movements GROUP BY 1) USING (case_id)) GROUP BY 1""",
)
def a2(m):
    """The movements of a twelfth of the cases each are another five weeks earlier."""
    days = (F.col("case_id") % 12 * 35).cast("int")
    earlier = m.movements().withColumn("occurred_on", F.date_sub("occurred_on", days))
    return coverage.movement_age(m.cases(), earlier, "2024-01-20")


@query(
    "a3_financial_coverage",
    "records_available l, records_not_provided l, orphan_records l, cases_with_records l, cases_without_records l, cases_with_multiple_records l",
    """SELECT (SELECT count(amount) FROM transactions) AS records_available, (SELECT count(*) - count(amount) FROM transactions) AS records_not_provided,
         (SELECT count(*) FROM transactions WHERE case_id IS NULL OR case_id NOT IN (SELECT case_id FROM cases)) AS orphan_records,
         count_if(n > 0) AS cases_with_records, count_if(n = 0) AS cases_without_records, count_if(n > 1) AS cases_with_multiple_records
       FROM (SELECT c.case_id, count(t.entry_id) AS n FROM cases c LEFT JOIN transactions t USING (case_id) GROUP BY 1)""",
)
def a3(m):
    return coverage.financial_coverage(m.cases(), m.transactions())


@query(
    "a4_customers_with_many_cases",
    "customers_with_many_cases l",
    "SELECT count(*) AS customers_with_many_cases FROM (SELECT 1 FROM case_customers GROUP BY customer_id HAVING count(*) > 1)",
)
def a4(m):
    return coverage.customers_with_many_cases(m.case_customers())


@query(
    "a7_status_counts",
    "status s, n l",
    """SELECT status, count(*) AS n FROM requests WHERE partner_id IN (SELECT partner_id FROM directory WHERE external_id LIKE 'SYNTHETIC-%')
       GROUP BY 1""",
)
def a7(m):
    return coverage.status_counts(m.requests(), links.in_scope(m.directory(), "synthetic"))


@query(
    "a8_distribution",
    "label s, count l, percent l",
    """SELECT stage AS label, count(*) AS count, round_even(100.0 * count(*) / (SELECT count(*) FROM cases), 0) AS percent FROM cases GROUP BY 1""",
)
def a8(m):
    return coverage.distribution(m.cases(), "stage")


@query(
    "a9_users_with_role",
    "users l",
    """SELECT count(DISTINCT user_id) AS users FROM users JOIN user_roles USING (user_id) JOIN roles USING (role_id)
       WHERE role = 'portal_admin' AND status = 'active'""",
)
def a9(m):
    return coverage.users_with_role(m.users(), m.user_roles(), m.roles(), "portal_admin")


@query(
    "s8_corpus_summary",
    "measure s, key s, n l",
    """WITH docs AS (SELECT text, 1 + n_chars // 2000 AS pages, n_chars % 7 AS items, CASE WHEN n_chars < 500 THEN ['zero_processes'] ELSE [] END AS f1,
         CASE WHEN lang <> 'en' THEN ['page_continuation', 'missing_identifier'] ELSE [] END AS f2,
         CASE source WHEN 'src0' THEN 'PDF_MALFORMED' WHEN 'src1' THEN 'LAYOUT_UNKNOWN' END AS rejection FROM documents),
       ok AS (SELECT * FROM docs WHERE rejection IS NULL)
       SELECT 'source_files' AS measure, '' AS key, count(*) AS n FROM docs
       UNION ALL SELECT 'unique_sources', '', count(DISTINCT sha256(text)) FROM ok
       UNION ALL SELECT 'page_count', '', sum(pages)::BIGINT FROM ok UNION ALL SELECT 'manifest_items', '', sum(items)::BIGINT FROM ok
       UNION ALL SELECT 'quality_flag', f, count(*) FROM (SELECT unnest(list_concat(f1, f2)) AS f FROM ok) GROUP BY 2
       UNION ALL SELECT 'rejected', rejection, count(*) FROM docs WHERE rejection IS NOT NULL GROUP BY 2""",
)
def s8(m):
    documents = m.stored("documents").selectExpr(
        "text",
        "1 + n_chars div 2000 as pages",
        "n_chars % 7 as items",
        "if(n_chars < 500, array('zero_processes'), cast(array() as array<string>)) as flags",
        "if(lang <> 'en', array('page_continuation', 'missing_identifier'), cast(array() as array<string>)) as item_flags",
        "case source when 'src0' then 'PDF_MALFORMED' when 'src1' then 'LAYOUT_UNKNOWN' end as rejection",
    )
    return coverage.corpus_summary(documents, F.col("text"))
