"""Derived statuses, gates, audits and account queries."""

from pyspark.sql import functions as F

from folioscope.operators import accounts, latest, status
from folioscope.plans.latest_queries import STATUS_SQL
from folioscope.plans.reconcile_queries import _LATEST_CORRECTION, _LATEST_RUN
from folioscope.plans.registry import query

NOW = "1998-02-01 12:00:00"


@query("q7_partner_status", "partner_id l, report_status s", STATUS_SQL)
def q7(m):
    changes = latest.last_change(m.changed_partners(), m.run_log())
    return status.partner_status(m.directory(), m.versions(), m.requests(), changes)


REPROCESS_SQL = f"""SELECT batch_id, r.run_id, coalesce(a.run_id = r.run_id AND NOT coalesce(processing_status = 'succeeded'
         AND processing_finished_at > a.created_at, FALSE), FALSE) AS reprocess_pending
       FROM batches JOIN {_LATEST_RUN} r USING (batch_id) LEFT JOIN (SELECT batch_id, run_id, created_at FROM (SELECT *, row_number() OVER
         (PARTITION BY batch_id ORDER BY review_revision DESC, review_id DESC) AS rn FROM reviews WHERE decision = 'reprocess_requested')
         WHERE rn = 1) a USING (batch_id)"""

BLOCKED_SQL = f"""SELECT b.*, coalesce(issues, 0) AS open_issues, coalesce(n_items, 0) = 0 OR coalesce(reprocess_pending, TRUE)
         OR coalesce(n_approved, 0) - CASE WHEN state = 'approved' THEN 1 ELSE 0 END > 1
         OR coalesce(n_rows, 0) <> parsed_item_count OR coalesce(n_flagged, 0) > 0 OR coalesce(unsolved, 0) > 0 AS approval_blocked
       FROM batches b LEFT JOIN (SELECT i.batch_id, count(*) AS n_items,
           count_if(NOT (status = 'matched' OR (status IN ('unmatched', 'ambiguous') AND c.item_id IS NOT NULL))) AS unsolved,
           count_if(status <> 'matched' AND c.item_id IS NULL) AS issues
         FROM items i JOIN {_LATEST_RUN} r ON r.run_id = i.run_id LEFT JOIN {_LATEST_CORRECTION} c ON c.item_id = i.item_id GROUP BY 1)
         USING (batch_id)
       LEFT JOIN (SELECT batch_id, count(*) AS n_rows, count_if(list_contains(quality_flags, 'missing_identifier')) AS n_flagged
         FROM items GROUP BY 1) USING (batch_id)
       LEFT JOIN ({REPROCESS_SQL}) USING (batch_id)
       LEFT JOIN (SELECT partner_id, period_start, period_end, count(*) AS n_approved FROM batches WHERE state = 'approved' GROUP BY ALL)
         USING (partner_id, period_start, period_end)"""


def _blocked(m):
    return status.approval_blocked(m.batches(), m.run_ids(), m.items(), m.reviews())


@query(
    "q8_batch_stage",
    "batch_id l, stage s",
    f"""SELECT batch_id, CASE WHEN state IN ('rejected', 'superseded') THEN state
         WHEN state = 'approved' AND q.status IN ('pending', 'running') THEN 'generating'
         WHEN v.status IN ('validated', 'published') THEN 'done'
         WHEN state = 'failed' OR (state IN ('quarantined', 'parsed', 'needs_review') AND processing_status = 'failed') THEN 'failed'
         WHEN state = 'needs_review' THEN CASE WHEN processing_status IN ('pending', 'running') THEN 'processing'
           WHEN open_issues > 0 THEN 'issues' WHEN approval_blocked THEN 'blocked' ELSE 'ready' END
         WHEN state = 'approved' AND q.status = 'failed' THEN 'generation_failed'
         WHEN state = 'approved' THEN 'approved' ELSE 'processing' END AS stage
       FROM ({BLOCKED_SQL}) b LEFT JOIN versions v USING (batch_id)
       LEFT JOIN requests q USING (batch_id)""",
)
def q8(m):
    return status.batch_stage(_blocked(m), m.versions(), m.requests())


@query("q9_approval_blocked", "batch_id l, open_issues l, approval_blocked b", BLOCKED_SQL)
def q9(m):
    return _blocked(m)


@query(
    "q10_invalid_transitions",
    "batch_id l, seq l, violation s",
    f"""SELECT batch_id, seq, violation FROM (SELECT batch_id, seq,
           CASE WHEN before IS NULL AND from_state IS NULL AND to_state = 'uploaded' THEN NULL
             WHEN from_state IS NULL OR from_state || '>' || to_state NOT IN ({", ".join(f"'{a}>{b}'" for a, to in status.TRANSITIONS.items() for b in to)})
               THEN 'not_allowed'
             WHEN before IS DISTINCT FROM from_state THEN 'chain_broken' END AS violation
         FROM (SELECT *, lag(to_state) OVER (PARTITION BY batch_id ORDER BY seq) AS before FROM state_log)) WHERE violation IS NOT NULL""",
)
def q10(m):
    return status.invalid_transitions(m.state_log())


@query("q11_reprocess_pending", "batch_id l, run_id l, reprocess_pending b", REPROCESS_SQL)
def q11(m):
    return status.reprocess_pending(m.batches(), m.run_ids(), m.reviews())


@query(
    "q12_constraint_report",
    "rule s, violations l",
    """SELECT 'status_values' AS rule, count_if(status NOT IN ('validated', 'published', 'superseded', 'draft')) AS violations FROM versions
       UNION ALL SELECT 'period_range', count_if(period_end < period_start) FROM versions
       UNION ALL SELECT 'object_present', count_if(storage_key IS NULL) FROM versions
       UNION ALL SELECT 'unique_version', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM versions
         GROUP BY partner_id, period_start, period_end, version)
       UNION ALL SELECT 'percentage_range', count_if(NOT percentage BETWEEN 0 AND 100) FROM directory
       UNION ALL SELECT 'transaction_case', count(*) FROM transactions WHERE case_id NOT IN (SELECT case_id FROM cases)
       UNION ALL SELECT 'amount_matches_status', count_if(amount IS NULL) FROM transactions""",
)
def q12(m):
    versions = status.constraint_report(
        m.versions(),
        {
            "status_values": F.col("status").isin("validated", "published", "superseded", "draft"),
            "period_range": F.col("period_end") >= F.col("period_start"),
            "object_present": F.col("storage_key").isNotNull(),
        },
    )
    amounts = m.transactions().withColumn("amount_status", F.lit("available"))
    parts = [
        status.unique_violations(m.versions(), ["partner_id", "period_start", "period_end", "version"], "unique_version"),
        status.constraint_report(m.directory(), {"percentage_range": F.col("percentage").between(0, 100)}),
        status.reference_violations(m.transactions(), "case_id", m.cases(), "case_id", "transaction_case"),
        status.constraint_report(amounts, {"amount_matches_status": status.amount_matches_status()}),
    ]
    for part in parts:
        versions = versions.unionByName(part)
    return versions


@query(
    "q13_unlisted_audit",
    "audit_id l, action s, entity_type s, reason_code s",
    """SELECT audit_id, action, entity_type, reason_code FROM (SELECT audit_id, CASE WHEN audit_id % 11 <> 0 THEN action END AS action,
         CASE audit_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'invoice' ELSE entity_type END AS entity_type, reason_code FROM audit_log)
       WHERE action IS NULL OR action = 'unknown_action' OR entity_type IS NULL OR entity_type = 'invoice' OR reason_code = 'other_reason'""",
)
def q13(m):
    """Some events lose their action or entity, or get an entity that isn't listed."""
    action = F.when(F.col("audit_id") % 11 != 0, F.col("action"))
    entity = F.when(F.col("audit_id") % 13 == 1, "invoice").when(F.col("audit_id") % 13 != 0, F.col("entity_type"))
    return status.unlisted_audit(m.audit_log().withColumns({"action": action, "entity_type": entity}))


@query(
    "q14_report_gate",
    "batch_id l, gate_reason s",
    f"""SELECT batch_id, CASE WHEN state <> 'approved' THEN 'batch_not_approved'
         WHEN b.partner_id NOT IN (SELECT partner_id FROM directory WHERE status = 'active' AND deleted_at IS NULL) THEN 'partner_not_live'
         WHEN r.run_id IS NULL OR r.parser_version <> b.parser_version OR result_total <> parsed_item_count OR snapshot_total < result_total
           OR timezone('America/Sao_Paulo', timezone('UTC', snapshot_verified_at))::DATE < period_end THEN 'snapshot_incomplete'
         WHEN coalesce(n_rows, 0) <> result_total OR coalesce(n_links, 0) <> result_total OR coalesce(flagged, 0) > 0
           OR coalesce(uncovered, 0) > 0 THEN 'review_incomplete'
         WHEN coalesce(ended, 0) > 0 THEN 'link_ended' WHEN coalesce(closed, 0) > 0 THEN 'case_inactive' END AS gate_reason
       FROM batches b LEFT JOIN (SELECT * FROM runs JOIN {_LATEST_RUN} USING (batch_id, run_id)) r USING (batch_id)
       LEFT JOIN (SELECT batch_id, count(*) AS n_rows, count_if(list_contains(quality_flags, 'missing_identifier')) AS flagged,
         count_if(item_id NOT IN (SELECT item_id FROM batch_links WHERE status = 'active')) AS uncovered FROM items GROUP BY 1) USING (batch_id)
       LEFT JOIN (SELECT batch_id, count(*) AS n_links, count_if(entity_id % 5 = 1) AS ended,
         count_if(entity_id NOT IN (SELECT case_id FROM targets WHERE status = 'active')) AS closed
         FROM batch_links WHERE status = 'active' GROUP BY 1) USING (batch_id)""",
)
def q14(m):
    """A fifth of the links ended before any period."""
    ended = F.when(F.col("entity_id") % 5 == 1, F.lit("1990-01-01").cast("date"))
    links = m.batch_links().withColumn("valid_to", ended)
    return status.report_gate(m.batches(), m.runs(), m.items(), links, m.directory(), m.targets())


@query(
    "q15_artifact_mismatches",
    "page_id l, reason s",
    """SELECT page_id, CASE WHEN doc IS NULL THEN 'missing' WHEN digest IS NULL OR digest <> sha256(html || doc) THEN 'digest' END AS reason
       FROM (SELECT page_id, html, d.text AS doc, CASE WHEN url LIKE 'https%' THEN sha256(html || d.text) WHEN url LIKE '%?%' THEN 'other' END
         AS digest FROM pages LEFT JOIN documents d ON d.doc_id = page_id AND d.lang <> 'de')
       WHERE doc IS NULL OR digest IS NULL OR digest <> sha256(html || doc)""",
)
def q15(m):
    """Pages play the html part and documents of the same number the printed part."""
    pages = m.stored("pages").withColumn("storage_key", F.col("page_id").cast("string"))
    documents = m.stored("documents").select(
        F.col("doc_id").cast("string").alias("storage_key"), F.col("text").alias("pdf"), "lang"
    )
    versions = pages.join(documents.drop("lang"), "storage_key", "left").select(
        "page_id",
        "storage_key",
        F.when(F.col("url").startswith("https"), F.sha2(F.concat("html", "pdf"), 256))
        .when(F.col("url").contains("?"), "other")
        .alias("content_sha256"),
    )
    files = pages.select("storage_key", "html").join(
        documents.filter("lang <> 'de'").drop("lang"), "storage_key", "left"
    )
    return status.artifact_mismatches(versions, files)


@query(
    "q16_four_eyes",
    "review_id s, violation s",
    """SELECT review_id, CASE WHEN reviewer = uploaded_by THEN 'same_person' WHEN review_id <> first_id THEN 'stale_revision' END AS violation
       FROM (SELECT r.*, b.uploaded_by, first_value(review_id) OVER (PARTITION BY r.batch_id, review_revision ORDER BY r.created_at, review_id)
         AS first_id FROM reviews r JOIN batches b USING (batch_id)) WHERE reviewer = uploaded_by OR review_id <> first_id""",
)
def q16(m):
    return status.four_eyes_violations(m.reviews(), m.batches())


@query(
    "pt14_account_list",
    "user_id l, status s, pending_link n, expired_link n",
    f"""SELECT user_id, u.status, p.link_id AS pending_link,
         CASE WHEN p.link_id IS NULL AND u.status = 'active' AND l.used_at IS NULL THEN l.link_id END AS expired_link
       FROM users u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, link_id DESC) AS rn
         FROM access_links WHERE used_at IS NULL AND expires_at > TIMESTAMP '{NOW}') WHERE rn = 1) p USING (user_id)
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, link_id DESC) AS rn
         FROM access_links) WHERE rn = 1) l USING (user_id)""",
)
def pt14(m):
    return accounts.account_list(m.users(), m.access_links(), NOW)


@query(
    "pt15_valid_links",
    "link_id l, user_id l",
    f"SELECT link_id, user_id FROM access_links WHERE used_at IS NULL AND expires_at > TIMESTAMP '{NOW}'",
)
def pt15(m):
    return accounts.valid_links(m.access_links(), NOW)


@query(
    "pt16_user_roles",
    "user_id l, role s",
    "SELECT DISTINCT user_id, role FROM user_roles JOIN roles USING (role_id) WHERE user_id IN (SELECT user_id FROM users)",
)
def pt16(m):
    return accounts.user_roles(m.users(), m.user_roles(), m.roles())
