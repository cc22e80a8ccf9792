"""Latest-per-key, paging, set and queue queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import latest, page_index
from folioscope.plans.registry import query
from folioscope.plans.steps import latest_movements
from folioscope.session import work_folder

PAGE_START, PAGE_END = "1997-01-15", "1998-03-10"

LATEST_VERSION_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY partner_id
       ORDER BY generated_at DESC, version DESC, version_id DESC) AS rn FROM versions WHERE status IN ('validated', 'published')) WHERE rn = 1"""
LATEST_REQUEST_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY partner_id
       ORDER BY created_at DESC, request_id DESC) AS rn FROM requests) WHERE rn = 1"""
LAST_CHANGE_SQL = """SELECT partner_id, max(finished_at) AS changed_at FROM changed_partners JOIN run_log USING (run_id)
       WHERE status = 'succeeded' GROUP BY 1"""
STATUS_SQL = f"""SELECT p.partner_id, p.name, p.external_id, p.status, CASE WHEN asked IN ('pending', 'running') THEN 'gerando'
         WHEN asked = 'failed' THEN 'erro' WHEN version_id IS NULL THEN 'sem relatório'
         WHEN changed_at > generated_at THEN 'desatualizado' ELSE 'atualizado' END AS report_status
       FROM (SELECT d.*, v.version_id, v.generated_at, c.changed_at,
           CASE WHEN v.generated_at IS NULL OR r.created_at > v.generated_at THEN r.status END AS asked
         FROM directory d LEFT JOIN ({LATEST_VERSION_SQL}) v USING (partner_id) LEFT JOIN ({LATEST_REQUEST_SQL}) r USING (partner_id)
         LEFT JOIN ({LAST_CHANGE_SQL}) c USING (partner_id)) p"""


@query("w1_latest_movement", "case_id l, last_movement_at t, last_movement_title s", "SELECT * FROM latest_moves")
def w1(m):
    return latest_movements(m)


@query("w2_latest_version", "partner_id l, version_id l, generated_at t", LATEST_VERSION_SQL)
def w2(m):
    return latest.latest_version(m.versions())


@query(
    "w3_latest_decision",
    "item_id s, review_id s, decision s, after_id n",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY review_revision DESC, review_id DESC) AS rn
       FROM reviews) WHERE rn = 1""",
)
def w3(m):
    return latest.latest_decision(m.reviews())


@query(
    "w4_latest_request",
    "partner_id l, request_id l, status s",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY status IN ('pending', 'running') DESC,
       created_at DESC, request_id DESC) AS rn FROM requests) WHERE rn = 1""",
)
def w4(m):
    return latest.latest_request(m.requests(), active_first=True)


@query(
    "w5_latest_run",
    "batch_id l, run_id l, created_at t",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1",
)
def w5(m):
    return latest.latest_run(m.runs())


@query(
    "w6_next_version",
    "partner_id l, period_start d, next_version l",
    """SELECT n.partner_id, n.period_start, coalesce(max(v.version), 0) + 1 AS next_version
       FROM (SELECT DISTINCT partner_id, period_start, period_end FROM batches) n LEFT JOIN
         versions v USING (partner_id, period_start, period_end) GROUP BY ALL""",
)
def w6(m):
    new = m.batches().select("partner_id", "period_start", "period_end").distinct()
    return latest.next_version(m.versions(), new)


@query(
    "w7_last_change",
    "partner_id l, changed_at t, last_sync_at t",
    f"""SELECT *, (SELECT max(finished_at) FROM run_log WHERE status = 'succeeded') AS last_sync_at FROM ({LAST_CHANGE_SQL})""",
)
def w7(m):
    return latest.last_change(m.changed_partners(), m.run_log()).withColumn(
        "last_sync_at", latest.last_sync(m.run_log()).scalar()
    )


@query(
    "w8_ready_reports",
    "version_id l, partner_id l, name s, generated_at t",
    """SELECT v.version_id, v.partner_id, d.name, v.generated_at FROM versions v JOIN directory d USING (partner_id)
       WHERE v.status IN ('validated', 'published') AND d.status = 'active' AND d.deleted_at IS NULL ORDER BY generated_at DESC, version_id DESC LIMIT 100""",
)
def w8(m):
    """A top-100 report; the limit is the feature."""
    return latest.ready_reports(m.versions(), m.directory(), 100)


@query(
    "w9_page",
    "batch_id l, partner_id l, state s, created_at t, total_rows l",
    f"""SELECT *, count(*) OVER () AS total_rows FROM batches WHERE state = 'needs_review' AND period_end >= DATE '{PAGE_START}'
        AND period_start <= DATE '{PAGE_END}' ORDER BY created_at DESC, batch_id DESC LIMIT 10 OFFSET 20""",
)
def w9(m):
    """The third page of ten; the limit is the feature."""
    condition = latest.batch_filter(state="needs_review", period_start=PAGE_START, period_end=PAGE_END)
    return latest.page(m.batches(), condition, [F.col("created_at").desc(), F.col("batch_id").desc()], number=3)


@query(
    "w10_catalog",
    "partner_id l, name s, external_id s, report_status s",
    f"""SELECT * FROM ({STATUS_SQL}) WHERE status = 'active' AND partner_id NOT IN (SELECT partner_id FROM directory WHERE deleted_at IS NOT NULL)
        AND (contains(lower(name), '#0000000') OR contains(lower(external_id), '#0000000'))""",
)
def w10(m):
    changes = latest.last_change(m.changed_partners(), m.run_log())
    return latest.catalog(m.directory(), m.versions(), m.requests(), changes, "#0000000")


@query(
    "w10_catalog_pages",
    "report_status s, partner_id l, page l, pages l, total_rows l",
    f"""WITH listed AS (SELECT *, row_number() OVER (PARTITION BY report_status ORDER BY name, external_id) AS rn,
         count(*) OVER (PARTITION BY report_status) AS total FROM ({STATUS_SQL}) WHERE status = 'active'
         AND partner_id NOT IN (SELECT partner_id FROM directory WHERE deleted_at IS NOT NULL))
       SELECT report_status, partner_id, CAST(ceil(total / 3) AS BIGINT) AS page, CAST(ceil(total / 3) AS BIGINT) AS pages, total AS total_rows
       FROM listed WHERE rn > (ceil(total / 3) - 1) * 3""",
)
def w10_pages(m):
    """The last page of each status, asked for with a number far behind it."""
    changes = latest.last_change(m.changed_partners(), m.run_log())
    states = ("atualizado", "desatualizado", "gerando", "erro", "sem relatório")
    return latest.catalog_pages(m.directory(), m.versions(), m.requests(), changes, states, 1_000_000, 3)


@query(
    "w9_deep_pages",
    "event_id l, page l, pages l, total_rows l",
    """WITH listed AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS total FROM events),
         wanted AS (SELECT CAST(unnest([1, ceil(total / 100), 7, greatest(floor(total / 50), 1)]) AS BIGINT) AS page
           FROM (SELECT count(*) AS total FROM events))
       SELECT event_id, page, CAST(ceil(total / 25) AS BIGINT) AS pages, total AS total_rows
       FROM listed JOIN (SELECT DISTINCT page FROM wanted) ON rn > (page - 1) * 25 AND rn <= page * 25""",
)
def w9_deep(m):
    """The first, the seventh and two pages deep inside the list of all events, newest first."""
    folder = work_folder(m.spark, "pages")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    events = m.stored("events").select("event_id", "ts")
    page_index.write_index(events, order, folder, 1 << 13)
    total = events.count()
    numbers = {1, -(-total // 100), 7, max(total // 50, 1)}
    return reduce(DataFrame.unionByName, [page_index.read_page(m.spark, folder, order, n, 25) for n in sorted(numbers)])


@query(
    "w11_set_operations",
    "operation s, case_id l",
    """SELECT 'union' AS operation, case_id FROM (SELECT case_id FROM movements UNION SELECT case_id FROM transactions WHERE case_id IS NOT NULL)
       UNION ALL SELECT 'difference', case_id FROM (SELECT case_id FROM cases EXCEPT SELECT case_id FROM transactions)
       UNION ALL SELECT 'intersection', case_id FROM (SELECT case_id FROM cases INTERSECT SELECT case_id FROM movements)""",
)
def w11(m):
    paid = m.transactions().filter("case_id is not null")
    parts = {
        "union": latest.set_union(m.movements(), paid, ["case_id"]),
        "difference": latest.set_diff(m.cases(), paid, ["case_id"]),
        "intersection": latest.set_intersection(m.cases(), m.movements(), ["case_id"]),
    }
    frames = [df.select(F.lit(name).alias("operation"), "case_id") for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "w12_retryable",
    "partner_id l, request_id l",
    """SELECT o_custkey AS partner_id, min(o_orderkey) AS request_id FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN
       (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') GROUP BY 1""",
)
def w12(m):
    """Orders play the requests of their customer."""
    requests = m.stored("orders").selectExpr(
        "o_orderkey as request_id",
        "o_custkey as partner_id",
        """case when o_orderstatus = 'P' then 'failed' when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'pending'
             else 'succeeded' end as status""",
    )
    return latest.retryable(requests)


@query(
    "w13_work_queue",
    "batch_id l, lane s, step s, open_items n",
    """SELECT batch_id, CASE WHEN step IN ('checking', 'generating') THEN 'in_progress' ELSE 'attention' END AS lane, step,
         CASE WHEN step = 'corrections_open' THEN open_items END AS open_items FROM (SELECT b.*,
         coalesce(r.open_items, parsed_item_count) AS open_items,
         CASE WHEN processing_status = 'failed' AND state IN ('quarantined', 'parsed', 'needs_review') THEN 'check_failed'
           WHEN state NOT IN ('needs_review', 'approved') OR processing_status IN ('pending', 'running') THEN 'checking'
           WHEN state = 'needs_review' AND coalesce(r.open_items, parsed_item_count) <> 0 THEN 'corrections_open'
           WHEN state = 'needs_review' THEN 'ready_to_approve'
           WHEN q.status IN ('pending', 'running') THEN 'generating' WHEN q.status = 'failed' THEN 'generation_failed'
           WHEN b.batch_id NOT IN (SELECT batch_id FROM versions WHERE status IN ('validated', 'published')) THEN 'report_not_generated'
         END AS step
         FROM (SELECT b.* FROM batches b JOIN directory USING (partner_id) WHERE state NOT IN ('rejected', 'superseded', 'failed')
           ORDER BY b.created_at DESC, batch_id DESC LIMIT 300) b
         LEFT JOIN (SELECT batch_id, result_total - matched_count AS open_items, row_number() OVER (PARTITION BY batch_id
           ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) r ON r.batch_id = b.batch_id AND r.rn = 1
         LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY status IN ('pending', 'running') DESC,
           created_at DESC, request_id DESC) AS rn FROM requests) q ON q.batch_id = b.batch_id AND q.rn = 1)
       WHERE step IS NOT NULL""",
)
def w13(m):
    """The newest 300 open batches; the limit is the feature."""
    return latest.work_queue(m.batches(), m.directory(), m.runs(), m.requests(), m.versions(), 300)


@query(
    "w14_last_n",
    "partner_id l, version_id l",
    """SELECT partner_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY generated_at DESC,
       version_id DESC) AS rn FROM versions) WHERE rn <= 5""",
)
def w14(m):
    return latest.last_n(m.versions(), ["partner_id"], [F.col("generated_at").desc(), F.col("version_id").desc()], 5)
