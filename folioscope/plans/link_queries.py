"""Link, eligibility and change-propagation queries."""

from pyspark.sql import functions as F

from folioscope.operators import links
from folioscope.plans.registry import query
from folioscope.plans.steps import AS_OF, LINK_DAY, active_links, eligible_cases, quality

EARLY_DAY = "1995-01-03"


@query("l1_effective_on", "link_id l, partner_id l", "SELECT link_id, partner_id FROM active_links")
def l1(m):
    return active_links(m)


@query(
    "l2_validate_linkage",
    "entity_type s, total l, linked l, unlinked l, multiple l, nonexistent l",
    """SELECT 'customer' AS entity_type, count(*) AS total, count_if(n = 1) AS linked, count_if(n = 0) AS unlinked,
         count_if(n > 1) AS multiple, (SELECT count(*) FROM links WHERE entity_type = 'customer'
           AND entity_id NOT IN (SELECT customer_id FROM customers)) AS nonexistent
       FROM (SELECT c.customer_id, count(DISTINCT l.partner_id) AS n FROM customers c LEFT JOIN active_links l
         ON l.entity_type = 'customer' AND l.entity_id = c.customer_id GROUP BY 1)
       UNION ALL SELECT 'case', count(*), count_if(n = 1), count_if(n = 0), count_if(n > 1),
         (SELECT count(*) FROM links WHERE entity_type = 'case' AND entity_id NOT IN (SELECT case_id FROM cases))
       FROM (SELECT c.case_id, count(DISTINCT s.partner_id) AS n FROM cases c LEFT JOIN (
           SELECT k.case_id, l.partner_id FROM case_customers k JOIN active_links l
             ON l.entity_type = 'customer' AND l.entity_id = k.customer_id
           UNION SELECT entity_id, partner_id FROM active_links WHERE entity_type = 'case') s USING (case_id) GROUP BY 1)""",
)
def l2(m):
    return links.validate_linkage(m.customers(), m.case_customers(), m.cases(), m.links(), LINK_DAY)


@query("l3_case_partner_sets", "case_id l, partner_id l", "SELECT * FROM case_sets")
def l3(m):
    return links.case_partner_sets(m.cases(), m.case_customers(), m.customers(), m.links(), LINK_DAY)


@query(
    "l4_eligible",
    "kind s, partner_id l, entity_id l",
    """SELECT 'case' AS kind, partner_id, case_id AS entity_id FROM eligible
       UNION ALL SELECT 'customer', partner_id, customer_id FROM (
         SELECT min(partner_id) AS partner_id, entity_id AS customer_id FROM active_links WHERE entity_type = 'customer'
           AND entity_id IN (SELECT customer_id FROM customers) GROUP BY entity_id HAVING count(DISTINCT partner_id) = 1
         UNION SELECT partner_id, customer_id FROM eligible JOIN known_pairs USING (case_id))""",
)
def l4(m):
    cases = eligible_cases(m)
    people = links.eligible_customers(cases, m.case_customers(), m.customers(), m.links(), LINK_DAY)
    return cases.select(F.lit("case").alias("kind"), "partner_id", F.col("case_id").alias("entity_id")).unionByName(
        people.select(F.lit("customer").alias("kind"), "partner_id", F.col("customer_id").alias("entity_id"))
    )


QUALITY_SQL = """SELECT partner_id, coalesce(n_eligible, 0) AS eligible_cases, coalesce(n_ambiguous, 0) AS ambiguous_cases,
       coalesce(n_missing, 0) AS missing_movements, coalesce(n_refs, 0) AS missing_customer_references,
       coalesce(n_lost, 0) AS nonexistent_links FROM partners
       LEFT JOIN (SELECT partner_id, count(*) AS n_eligible, count_if(case_id NOT IN (SELECT case_id FROM latest_moves)) AS n_missing
         FROM eligible GROUP BY 1) USING (partner_id)
       LEFT JOIN (SELECT partner_id, count(*) AS n_ambiguous FROM case_sets WHERE case_id IN (SELECT case_id FROM case_sets
         GROUP BY 1 HAVING count(*) > 1) GROUP BY 1) USING (partner_id)
       LEFT JOIN (SELECT partner_id, count(*) AS n_refs FROM eligible JOIN case_customers USING (case_id)
         WHERE customer_id NOT IN (SELECT customer_id FROM customers) GROUP BY 1) USING (partner_id)
       LEFT JOIN (SELECT partner_id, count(*) AS n_lost FROM active_links WHERE (entity_type = 'case' AND entity_id NOT IN
         (SELECT case_id FROM cases)) OR (entity_type = 'customer' AND entity_id NOT IN (SELECT customer_id FROM customers))
         GROUP BY 1) USING (partner_id)"""
QUALITY_SHAPE = (
    "partner_id l, eligible_cases l, ambiguous_cases l, missing_movements l, missing_customer_references l, nonexistent_links l"
)


@query("l5_portfolio_quality", QUALITY_SHAPE, QUALITY_SQL)
def l5(m):
    return quality(m)


@query(
    "l5_source_quality",
    "unlinked_cases l, missing_customer_references l, nonexistent_links l",
    """SELECT (SELECT count(*) FROM cases WHERE case_id NOT IN (SELECT case_id FROM case_sets)) AS unlinked_cases,
       (SELECT count(*) FROM case_customers WHERE customer_id NOT IN (SELECT customer_id FROM customers))
         AS missing_customer_references,
       (SELECT count(*) FROM active_links WHERE (entity_type = 'case' AND entity_id NOT IN (SELECT case_id FROM cases))
         OR (entity_type = 'customer' AND entity_id NOT IN (SELECT customer_id FROM customers))) AS nonexistent_links""",
)
def l5_source(m):
    return links.source_quality(m.cases(), m.case_customers(), m.customers(), m.links(), LINK_DAY)


@query(
    "l6_technical_gate",
    "partner_id l, status s, eligible_cases n, reason s",
    f"""SELECT partner_id, CASE WHEN ready THEN 'available' ELSE 'pending_validation' END AS status,
        CASE WHEN ready THEN eligible_cases END AS eligible_cases,
        CASE WHEN NOT ready THEN 'linkage_not_approved_or_conflict' END AS reason
        FROM (SELECT q.*, q.ambiguous_cases = 0 AND q.nonexistent_links = 0 AND p.status = 'active' AS ready
          FROM ({QUALITY_SQL}) q JOIN partners p USING (partner_id))""",
    link_day=EARLY_DAY,
)
def l6(m):
    """The gate on an early day, when some portfolios are still free of conflicts."""
    rated = links.technical_gate(
        quality(m, EARLY_DAY).join(m.partners().select("partner_id", "status"), "partner_id"),
        F.lit(True),
        F.col("status") == "active",
    )
    wrapped = links.apply_gate(rated, {"eligible_cases": "governed_partner_mapping"}, F.lit(AS_OF).cast("timestamp"))
    value = F.col("eligible_cases.value").alias("eligible_cases")
    return wrapped.select("partner_id", "eligible_cases.status", value, "eligible_cases.reason")


CASE_REFS_SQL = """SELECT partner_id, case_id, 'L-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END
       AS reference FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY case_id) AS n FROM eligible)"""


@query("l7_anonymous_refs", "partner_id l, case_id l, reference s", CASE_REFS_SQL)
def l7(m):
    return links.anonymous_refs(eligible_cases(m), "partner_id", "case_id", "L")


@query(
    "l8_related_refs",
    "partner_id l, case_reference s, customer_reference s",
    f"""SELECT a.partner_id, a.reference AS case_reference, b.reference AS customer_reference FROM ({CASE_REFS_SQL}) a
        JOIN case_customers USING (case_id) JOIN (
          SELECT partner_id, customer_id, 'C-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS reference
          FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY customer_id) AS n FROM (
            SELECT min(partner_id) AS partner_id, entity_id AS customer_id FROM active_links WHERE entity_type = 'customer'
              AND entity_id IN (SELECT customer_id FROM customers) GROUP BY entity_id HAVING count(DISTINCT partner_id) = 1
            UNION SELECT partner_id, customer_id FROM eligible JOIN known_pairs USING (case_id)))) b
        ON b.partner_id = a.partner_id AND b.customer_id = case_customers.customer_id""",
)
def l8(m):
    cases = eligible_cases(m)
    people = links.eligible_customers(cases, m.case_customers(), m.customers(), m.links(), LINK_DAY)
    return links.related_refs(
        m.case_customers(),
        links.anonymous_refs(cases, "partner_id", "case_id", "L"),
        links.anonymous_refs(people, "partner_id", "customer_id", "C"),
    )


@query(
    "l9_availability",
    "entry_id l, case_id n, status s, fees m, source s, reason s, consistent b",
    """SELECT entry_id, case_id, CASE WHEN amount IS NULL THEN 'not_provided' ELSE 'available' END AS status, amount AS fees,
       'transactions' AS source, CASE WHEN amount IS NULL THEN 'no_amount' END AS reason, TRUE AS consistent
       FROM transactions""",
)
def l9(m):
    from folioscope.functions.availability import availability, is_consistent

    wrapped = availability(
        F.col("amount"), "transactions", F.lit(AS_OF).cast("timestamp"), missing_reason="no_amount"
    )
    return (
        m.transactions()
        .select("entry_id", "case_id", wrapped.alias("w"))
        .select("entry_id", "case_id", "w.status", F.col("w.value").alias("fees"), "w.source", "w.reason", is_consistent(F.col("w")).alias("consistent"))
    )


@query(
    "l10_preview_alerts",
    "partner_id l, code s, count n",
    f"""SELECT partner_id, 'missing_movement' AS code, missing_movements AS count FROM ({QUALITY_SQL}) WHERE missing_movements > 0
        UNION ALL SELECT partner_id, 'missing_customer_reference', missing_customer_references FROM ({QUALITY_SQL})
          WHERE missing_customer_references > 0
        UNION ALL SELECT partner_id, 'freshness_threshold_pending', NULL FROM partners""",
)
def l10(m):
    return links.preview_alerts(quality(m))


@query(
    "l11_affected_partners",
    "partner_id l",
    """WITH hit AS (SELECT 'customer' AS t, customer_id AS id FROM customers WHERE status = 'inactive'
         UNION SELECT 'case', case_id FROM case_customers WHERE customer_id IN
           (SELECT customer_id FROM customers WHERE status = 'inactive')
         UNION SELECT 'case', case_id FROM cases WHERE status = 'inactive'
         UNION SELECT 'customer', customer_id FROM case_customers WHERE case_id IN
           (SELECT case_id FROM cases WHERE status = 'inactive'))
       SELECT DISTINCT partner_id FROM active_links JOIN hit ON t = entity_type AND id = entity_id""",
)
def l11(m):
    return links.affected_partners(
        m.customers().filter("status = 'inactive'").select("customer_id"),
        m.cases().filter("status = 'inactive'").select("case_id"),
        m.case_customers(),
        m.links(),
        LINK_DAY,
    )


@query(
    "l12_overlapping_links",
    "link_id l",
    """SELECT link_id FROM (SELECT link_id, valid_from, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY entity_id
         ORDER BY valid_from, link_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
       FROM (SELECT o_orderkey AS link_id, o_custkey AS entity_id, o_orderdate::DATE AS valid_from,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE + 90 END AS valid_to FROM orders WHERE o_orderstatus <> 'P'))
       WHERE reach >= valid_from""",
)
def l12(m):
    """Orders read as links of their customer."""
    as_links = m.stored("orders").selectExpr(
        "o_orderkey as link_id",
        "'customer' as entity_type",
        "o_custkey as entity_id",
        "cast(o_orderdate as date) as valid_from",
        "if(o_orderpriority = '5-LOW', null, date_add(cast(o_orderdate as date), 90)) as valid_to",
        "if(o_orderstatus = 'P', 'inactive', 'active') as status",
    )
    return links.overlapping_links(as_links)


@query(
    "l13_check_link_targets",
    "link_id l, violation s",
    """SELECT link_id, violation FROM (SELECT link_id, CASE
         WHEN (customer_id IS NOT NULL)::INT + (case_id IS NOT NULL)::INT <> 1 THEN 'target_count'
         WHEN entity_type <> CASE WHEN customer_id IS NOT NULL THEN 'customer' ELSE 'case' END THEN 'target_type'
         WHEN (customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers))
           OR (customer_id IS NULL AND case_id NOT IN (SELECT case_id FROM cases)) THEN 'target_unknown'
         WHEN entity_id <> coalesce(customer_id, case_id) THEN 'target_identifier'
         WHEN valid_to < valid_from THEN 'period' END AS violation
       FROM (SELECT link_id, entity_type, entity_id, valid_from,
           CASE WHEN partner_id = 3 THEN valid_from - 1 ELSE valid_to END AS valid_to,
           CASE WHEN entity_type = 'customer' OR partner_id = 7 THEN entity_id + CASE WHEN partner_id = 5 THEN 1 ELSE 0 END END AS customer_id,
           CASE WHEN entity_type = 'case' AND partner_id <> 11 THEN entity_id END AS case_id FROM links))
       WHERE violation IS NOT NULL""",
)
def l13(m):
    """Links with some targets made inconsistent by partner."""
    two_columns = m.links().selectExpr(
        "link_id",
        "entity_type",
        "entity_id",
        "valid_from",
        "if(partner_id = 3, date_sub(valid_from, 1), valid_to) as valid_to",
        "if(entity_type = 'customer' or partner_id = 7, entity_id + if(partner_id = 5, 1, 0), null) as customer_id",
        "if(entity_type = 'case' and partner_id <> 11, entity_id, null) as case_id",
    )
    return links.check_link_targets(two_columns, m.customers(), m.cases())


@query(
    "l14_links_match_review",
    "link_id s, consistent b",
    """SELECT l.link_id, CASE WHEN i.status = 'matched' THEN l.entity_id IS NOT DISTINCT FROM i.matched_id
         AND l.match_method IS NOT DISTINCT FROM i.method AND l.evidence IS NOT DISTINCT FROM i.evidence
         ELSE coalesce(l.match_method = 'manual_existing_id' AND l.entity_id = r.after_id, FALSE) END AS consistent
       FROM (SELECT link_id, item_id, entity_id, match_method, evidence FROM batch_links
         UNION ALL SELECT review_id, item_id, after_id, 'manual_existing_id', NULL FROM reviews WHERE decision = 'corrected') l
       LEFT JOIN items i USING (item_id)
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY review_revision DESC, review_id DESC)
         AS rn FROM reviews WHERE decision = 'corrected') WHERE rn = 1) r USING (item_id)""",
)
def l14(m):
    """Links written by approval, and one manual link per correction."""
    manual = m.reviews().filter("decision = 'corrected'").select(
        F.col("review_id").alias("link_id"),
        "item_id",
        "batch_id",
        F.col("after_id").alias("entity_id"),
        F.lit("manual_existing_id").alias("match_method"),
        F.lit(None).cast("string").alias("evidence"),
    )
    both = m.batch_links().drop("status").unionByName(manual)
    return links.check_links_match_review(both, m.items(), m.reviews())


@query(
    "l15_governed_mappings",
    "entity_type s, entity_id l, partner_id l",
    """SELECT entity_type, entity_id, partner_id FROM active_links WHERE partner_id IN
       (SELECT partner_id FROM partners WHERE status = 'active' AND code NOT LIKE 'SYNTHETIC-%')""",
)
def l15(m):
    return links.governed_mappings(m.partners(), m.links(), LINK_DAY)


@query(
    "l16_in_scope",
    "scope s, partner_id l",
    """SELECT 'synthetic' AS scope, partner_id FROM directory WHERE external_id LIKE 'SYNTHETIC-%'
       UNION ALL SELECT 'pilot', partner_id FROM directory WHERE pilot_enabled AND external_id NOT LIKE 'SYNTHETIC-%'""",
)
def l16(m):
    parts = [
        links.in_scope(m.directory(), scope).select(F.lit(scope).alias("scope"), "partner_id")
        for scope in ("synthetic", "pilot")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "l17_minimal_snapshot",
    "part s, entity_id l",
    """WITH hit AS (SELECT DISTINCT matched_id AS case_id FROM items WHERE status = 'matched')
       SELECT 'case' AS part, external_id AS entity_id FROM candidates WHERE external_id IN (SELECT case_id FROM hit)
       UNION ALL SELECT DISTINCT 'customer', customer_id FROM case_customers WHERE case_id IN (SELECT case_id FROM hit)
       UNION ALL SELECT 'lost', case_id FROM hit WHERE case_id NOT IN (SELECT external_id FROM candidates)""",
)
def l17(m):
    parts = links.minimal_snapshot(m.items(), m.candidates(), m.case_customers())
    return (
        parts["cases"].select(F.lit("case").alias("part"), F.col("external_id").alias("entity_id"))
        .unionByName(parts["customers"].select(F.lit("customer").alias("part"), F.col("customer_id").alias("entity_id")))
        .unionByName(parts["lost"].select(F.lit("lost").alias("part"), F.col("external_id").alias("entity_id")))
    )


@query(
    "l18_enrichment_coverage",
    "referenced_customers l, customers_found l, transactions_found l, movements_found l, repeated_transactions l",
    """WITH hit AS (SELECT DISTINCT matched_id AS case_id FROM items WHERE status = 'matched'),
       ref AS (SELECT DISTINCT customer_id FROM case_customers JOIN hit USING (case_id))
       SELECT (SELECT count(*) FROM ref) AS referenced_customers,
         (SELECT count(*) FROM customers WHERE customer_id IN (SELECT customer_id FROM ref)) AS customers_found,
         (SELECT count(DISTINCT entry_id) FROM transactions WHERE case_id IN (SELECT case_id FROM hit)) AS transactions_found,
         (SELECT count(*) FROM movements WHERE case_id IN (SELECT case_id FROM hit)) AS movements_found,
         (SELECT count(*) FROM (SELECT entry_id FROM transactions WHERE case_id IN (SELECT case_id FROM hit) GROUP BY 1
           HAVING count(*) > 1)) AS repeated_transactions""",
)
def l18(m):
    return links.enrichment_coverage(m.items(), m.case_customers(), m.customers(), m.transactions(), m.movements())
