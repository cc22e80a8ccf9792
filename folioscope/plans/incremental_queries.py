"""Incremental load, versioning, retention, profiling and consistency queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import consistency, finance, incremental, links, profile, retention
from folioscope.operators.latest import latest_run
from folioscope.operators.spread import dealt
from folioscope.plans.latest_queries import LATEST_VERSION_SQL
from folioscope.plans.link_queries import QUALITY_SQL
from folioscope.plans.registry import query
from folioscope.plans.steps import LINK_DAY, accounts, quality

NOW = "1999-03-31 12:00:00"

# The stored state is an older version of the source: some rows are missing, some differ.


def _customer_hash(name: str):
    return F.sha2(F.concat_ws("|", "customer_id", name, F.coalesce("origin", F.lit(""))), 256)


def _stored_customers(m):
    kept = m.customers().filter("origin is null or origin <> 'FURNITURE'")
    older = F.when(F.col("origin") == "MACHINERY", F.lower("name")).otherwise(F.col("name"))
    return kept.withColumn("name", older).select("customer_id", "name", _customer_hash("name").alias("row_hash"), "status")


def _new_customers(m):
    fresh = m.customers().filter("origin is null or origin <> 'BUILDING'")
    return fresh.select("customer_id", "name", _customer_hash("name").alias("row_hash"))


def _customer_state(m):
    return incremental.upsert(_stored_customers(m), _new_customers(m), "customer_id")


CUSTOMER_STATE_SQL = """SELECT customer_id, name, CASE WHEN action IN ('insert', 'update') THEN 'active' ELSE status END AS status, action
       FROM (SELECT *, CASE origin WHEN 'BUILDING' THEN 'absent' WHEN 'FURNITURE' THEN 'insert' WHEN 'MACHINERY' THEN 'update'
         ELSE CASE WHEN status <> 'active' THEN 'update' ELSE 'keep' END END AS action
         FROM (SELECT * REPLACE (coalesce(origin, 'HOUSEHOLD') AS origin) FROM customers))"""


@query("i1_upsert_customers", "customer_id l, name s, status s, action s", CUSTOMER_STATE_SQL)
def i1(m):
    return _customer_state(m)


def _stored_cases(m):
    return m.cases().filter("step <> 'JUDICIAL'").select(
        "case_id", F.when(F.col("stage") == "RPV EMITIDO", "old").otherwise(F.col("stage")).alias("row_hash"), "status"
    )


def _case_parts(m, deal=False):
    source = m.cases().select("case_id", F.col("stage").alias("row_hash"))
    stored_pairs = m.case_customers().join(
        m.cases().filter("step <> 'JUDICIAL' and stage <> 'RPV EMITIDO'").select("case_id"), "case_id", "left_semi"
    )
    gone = m.cases().filter("stage = 'HONORÁRIOS QUITADOS' and step <> 'JUDICIAL'").select(
        "case_id", F.lit(5).cast("bigint").alias("customer_id")
    )
    wanted = m.case_customers().withColumn("page_offset", F.floor(F.col("case_id") / 100) * 100)
    if deal:
        wanted = dealt(wanted, "customer_id")
    return incremental.upsert_cases(
        _stored_cases(m), stored_pairs.unionByName(gone).distinct(), source, wanted, m.customers()
    )


CASE_STATE_SQL = """SELECT case_id, CASE WHEN step = 'JUDICIAL' THEN 'insert' WHEN stage = 'RPV EMITIDO' OR status <> 'active' THEN 'update'
         ELSE 'keep' END AS action FROM cases"""
BRIDGE_SQL = """SELECT coalesce(s.case_id, w.case_id) AS case_id, coalesce(s.customer_id, w.customer_id) AS customer_id,
         CASE WHEN w.case_id IS NULL THEN 'delete' WHEN s.case_id IS NULL THEN 'add' ELSE 'keep' END AS action
       FROM (SELECT k.* FROM case_customers k JOIN cases USING (case_id) WHERE step <> 'JUDICIAL' AND stage <> 'RPV EMITIDO'
         UNION SELECT case_id, 5 FROM cases WHERE stage = 'HONORÁRIOS QUITADOS' AND step <> 'JUDICIAL') s
       FULL JOIN (SELECT * FROM known_pairs) w ON w.case_id = s.case_id AND w.customer_id = s.customer_id"""


@query(
    "i2_upsert_cases",
    "part s, case_id l, customer_id l, action s",
    f"""SELECT 'case' AS part, case_id, 0 AS customer_id, action FROM ({CASE_STATE_SQL})
        UNION ALL SELECT 'pair', case_id, customer_id, action FROM ({BRIDGE_SQL})""",
)
def i2(m):
    parts = _case_parts(m)
    cases = parts["cases"].select(F.lit("case").alias("part"), "case_id", F.lit(0).alias("customer_id"), "action")
    pairs = parts["bridge"].select(F.lit("pair").alias("part"), "case_id", "customer_id", "action")
    return cases.unionByName(pairs)


def _transaction_parts(m, deal=False):
    hashed = m.transactions().select("entry_id", "case_id", F.col("category").alias("row_hash"), "entry_type", "date_due")
    stored = hashed.filter("entry_type = 'income'").select(
        "entry_id",
        F.when(F.col("date_due") < "1998-01-01", F.col("case_id") + 1).otherwise(F.col("case_id")).alias("case_id"),
        "row_hash",
    )
    source = hashed.select("entry_id", "case_id", "row_hash", F.lit(0).alias("page_offset"))
    return incremental.upsert_transactions(
        stored, dealt(source, "case_id") if deal else source, m.cases()
    )


TRANSACTION_STATE_SQL = """SELECT entry_id, now_case AS case_id, CASE WHEN entry_type <> 'income' THEN 'insert'
         WHEN now_case IS DISTINCT FROM old_case THEN 'update' ELSE 'keep' END AS action, old_case FROM (SELECT *,
         CASE WHEN case_id IN (SELECT case_id FROM cases) THEN case_id END AS now_case,
         CASE WHEN entry_type = 'income' THEN CASE WHEN date_due < DATE '1998-01-01' THEN case_id + 1 ELSE case_id END END AS old_case
         FROM transactions)"""


@query("i3_upsert_transactions", "entry_id l, case_id n, action s", TRANSACTION_STATE_SQL)
def i3(m):
    return _transaction_parts(m)["transactions"]


CHANGED_CASES_SQL = f"""SELECT DISTINCT c AS case_id FROM (SELECT case_id AS c FROM ({TRANSACTION_STATE_SQL}) WHERE action <> 'keep'
        UNION ALL SELECT old_case FROM ({TRANSACTION_STATE_SQL}) WHERE action <> 'keep') WHERE c IS NOT NULL"""


@query("i3_changed_cases", "case_id l", CHANGED_CASES_SQL)
def i3_cases(m):
    return _transaction_parts(m)["changed_cases"]


def _movement_parts(m):
    source = m.movements().select(
        F.when(F.col("title") == "signup", F.col("case_id") + 1000000000).otherwise(F.col("case_id")).alias("case_id"),
        F.concat_ws("|", F.to_date("occurred_at"), "title").alias("fingerprint"),
        F.lit(0).alias("page_offset"),
        "title",
    )
    stored = source.filter("title = 'view'")
    return incremental.append_movements(stored, source, m.cases())


@query(
    "i4_append_movements",
    "case_id l, fingerprint s",
    """SELECT DISTINCT case_id, concat_ws('|', occurred_at::DATE, title) AS fingerprint FROM movements
       WHERE title NOT IN ('view', 'signup') AND case_id IN (SELECT case_id FROM cases)""",
)
def i4(m):
    return _movement_parts(m)["new"]


@query(
    "i5_changed_partners",
    "run_id l, partner_id l",
    f"""WITH changed_cases AS ({CHANGED_CASES_SQL} UNION SELECT case_id FROM movements
         WHERE title NOT IN ('view', 'signup') AND case_id IN (SELECT case_id FROM cases)),
       hit AS (SELECT 'customer' AS t, customer_id AS id FROM ({CUSTOMER_STATE_SQL}) WHERE action IN ('insert', 'update')
         UNION SELECT 'case', case_id FROM case_customers WHERE customer_id IN
           (SELECT customer_id FROM ({CUSTOMER_STATE_SQL}) WHERE action IN ('insert', 'update'))
         UNION SELECT 'case', case_id FROM changed_cases
         UNION SELECT 'customer', customer_id FROM case_customers WHERE case_id IN (SELECT case_id FROM changed_cases))
       SELECT DISTINCT 7 AS run_id, partner_id FROM active_links JOIN hit ON t = entity_type AND id = entity_id""",
)
def i5(m):
    """Partners of changed customers, of the old and new cases of transactions, and of cases with new movements."""
    changed = incremental.changed_keys(_customer_state(m), "customer_id")
    cases = _transaction_parts(m)["changed_cases"].unionByName(_movement_parts(m)["changed_cases"]).distinct()
    affected = links.affected_partners(changed, cases, m.case_customers(), m.links(), LINK_DAY)
    return incremental.changed_partners(7, affected)


@query(
    "i6_missing_references",
    "error_code s, page_offset l, reference l",
    """SELECT 'missing_customer' AS error_code, (case_id // 100) * 100 AS page_offset, customer_id AS reference FROM case_customers
         WHERE customer_id NOT IN (SELECT customer_id FROM customers)
       UNION ALL SELECT 'missing_lawsuit', 0, case_id FROM transactions WHERE case_id NOT IN (SELECT case_id FROM cases)
       UNION ALL SELECT 'missing_lawsuit', 0, case_id + 1000000000 FROM movements WHERE title = 'signup'""",
)
def i6(m):
    parts = [
        _case_parts(m, deal=True)["errors"].withColumnRenamed("customer_id", "reference"),
        _transaction_parts(m, deal=True)["errors"].withColumnRenamed("case_id", "reference"),
        _movement_parts(m)["errors"].withColumnRenamed("case_id", "reference"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _error_log(m):
    """Errors of one run per customer segment, some of them resolved."""
    return m.case_customers().join(m.cases().select("case_id", "step", "stage"), "case_id").select(
        F.col("step").alias("run_id"),
        F.lit("lawsuits").alias("resource"),
        (F.floor(F.col("case_id") / 100) * 100 + 100).alias("page_offset"),
        F.when(F.col("stage") == "RPV EMITIDO", F.lit(NOW).cast("timestamp")).alias("resolved_at"),
    )


@query(
    "i7_run_summary",
    "fetched l, inserted l, updated l, errors l, changed_partners l, status s",
    f"""SELECT count(*) AS fetched, count_if(action = 'insert') AS inserted, count_if(action = 'update') AS updated,
         (SELECT count(*) FROM case_customers JOIN cases USING (case_id) WHERE stage <> 'RPV EMITIDO') AS errors,
         (SELECT count(*) FROM partners) AS changed_partners, 'partial' AS status
       FROM ({CUSTOMER_STATE_SQL}) WHERE action <> 'absent'""",
)
def i7(m):
    return incremental.run_summary(_customer_state(m), _error_log(m), m.partners(), 100, 100)


@query(
    "i8_reprocess_from",
    "run_id s, resource s, page_offset l",
    """SELECT step AS run_id, 'lawsuits' AS resource, min((case_id // 100) * 100 + 100) AS page_offset FROM case_customers
       JOIN cases USING (case_id) WHERE stage <> 'RPV EMITIDO' AND NOT (stage = 'HONORÁRIOS QUITADOS' AND (case_id // 100) * 100 + 100 = 200)
         AND (case_id // 100) * 100 + 100 <> 200 GROUP BY 1""",
)
def i8(m):
    """The restart point after the page at offset 200 was read again."""
    return incremental.reprocess_from(incremental.resolve_errors(_error_log(m), 200, NOW))


#: Batches of every second order; with all of them every partner would have an approved one.
APPROVED_SQL = """WITH approved AS (SELECT CASE WHEN batch_id % 2 = 0 THEN partner_id ELSE -partner_id END AS partner_id FROM batches
         WHERE state = 'approved')"""


@query(
    "i9_change_cycle",
    "partner_id l, outcome s",
    f"""{APPROVED_SQL} SELECT d.partner_id, CASE WHEN 'd1' IS NOT DISTINCT FROM v.source_digest THEN 'unchanged'
         WHEN d.partner_id IN (SELECT partner_id FROM requests WHERE status IN ('pending', 'running')) THEN 'already_active' ELSE 'queued' END AS outcome
       FROM directory d LEFT JOIN ({LATEST_VERSION_SQL}) v USING (partner_id)
       WHERE d.status = 'active' AND d.deleted_at IS NULL AND d.partner_id NOT IN (SELECT partner_id FROM approved)""",
)
def i9(m):
    sources = m.directory().select("partner_id", F.lit("d1").alias("source_digest"))
    # Half of the batches belong to partners outside the directory.
    owner = F.when(F.col("batch_id") % 2 == 0, F.col("partner_id")).otherwise(-F.col("partner_id"))
    batches = m.batches().withColumn("partner_id", owner)
    return incremental.change_cycle(sources, m.directory(), m.versions(), batches, m.requests())


@query(
    "i9_cycle_counts",
    "scanned l, changed l, queued l",
    f"""{APPROVED_SQL} SELECT count(*) AS scanned, count_if(source_digest IS DISTINCT FROM 'd1') AS changed,
         count_if(source_digest IS DISTINCT FROM 'd1' AND d.partner_id NOT IN (SELECT partner_id FROM requests WHERE status IN ('pending', 'running'))) AS queued
       FROM directory d LEFT JOIN ({LATEST_VERSION_SQL}) v USING (partner_id)
       WHERE d.status = 'active' AND d.deleted_at IS NULL AND d.partner_id NOT IN (SELECT partner_id FROM approved)""",
)
def i9_counts(m):
    return incremental.cycle_counts(i9(m))


_WORDS = ", ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT::HUGEINT)" for i in range(4))


SHOWN = ("case_id", "entries", *finance.ACCOUNT_FIELDS)


@query(
    "i10_revision_key",
    "batch_id l, partner_id l, revision_key s",
    f"""SELECT batch_id, partner_id, sha256(concat('{{"batch_id":', batch_id, ',"content_sha256":', CASE WHEN content IS NULL THEN 'null' ELSE '"' || content || '"' END,
         ',"parser_version":"', r.parser_version, '","partner_id":', partner_id, ',"percentage":', percentage,
         ',"period_end":"', strftime(period_end, '%Y-%m-%d'), '","period_start":"', strftime(period_start, '%Y-%m-%d'),
         '","rules":"stage-1+finance-1","snapshot_sha256":"', snapshot_sha256, '"}}')) AS revision_key
       FROM batches b JOIN partners USING (partner_id)
       JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1) r
         USING (batch_id)
       LEFT JOIN (SELECT partner_id, sha256(concat_ws(':', count(*), {_WORDS})) AS content FROM (SELECT partner_id,
         sha256(concat_ws(chr(31), {", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in SHOWN)})) AS h FROM accounts) GROUP BY 1) USING (partner_id)""",
)
def i10(m):
    """One key per batch, over the statement rows of its partner, the period, the parser and the snapshot."""
    run = latest_run(m.runs()).select("batch_id", "parser_version", "snapshot_sha256")
    batches = m.batches().select("batch_id", "partner_id", "period_start", "period_end").join(run, "batch_id")
    meta = batches.join(m.partners().select("partner_id", "percentage"), "partner_id")
    meta = meta.withColumn("rules", F.lit("stage-1+finance-1"))
    return incremental.revision_key(accounts(m), meta, "partner_id", SHOWN, ["batch_id"])


@query(
    "i11_count_regressions",
    "partner_id l, previous_customers l, previous_cases l",
    f"""SELECT v.partner_id, v.customer_count AS previous_customers, v.case_count AS previous_cases FROM ({LATEST_VERSION_SQL}) v
       JOIN (SELECT partner_id, count(*) AS n FROM versions GROUP BY 1) c USING (partner_id) WHERE n < v.customer_count OR n < v.case_count""",
)
def i11(m):
    new = m.versions().groupBy("partner_id").agg(F.count(F.lit(1)).alias("customer_count")).withColumn(
        "case_count", F.col("customer_count")
    )
    return incremental.count_regressions(new, m.versions())


@query(
    "i12_replace_in_scope",
    "part s, entry_id l, category s",
    """WITH scope AS (SELECT case_id FROM cases WHERE step = 'JUDICIAL'), inside AS (SELECT * FROM transactions WHERE case_id IN (SELECT case_id FROM scope))
       SELECT 'state' AS part, entry_id, category FROM transactions WHERE case_id IS NULL OR case_id NOT IN (SELECT case_id FROM scope)
       UNION ALL SELECT 'state', entry_id, lower(category) FROM inside WHERE entry_type = 'income'
       UNION ALL SELECT 'deleted', entry_id, '' FROM inside WHERE entry_type <> 'income'
       UNION ALL SELECT 'foreign', entry_id, lower(category) FROM transactions JOIN cases USING (case_id)
         WHERE entry_type = 'income' AND step = 'ETAPA NOVA' AND stage = 'RPV EMITIDO'""",
)
def i12(m):
    """The income of judicial cases replaces their entries; some rows of other cases are refused."""
    staged = m.transactions().join(m.cases().select("case_id", "step", "stage"), "case_id")
    source = staged.filter(
        "entry_type = 'income' and (step = 'JUDICIAL' or (step = 'ETAPA NOVA' and stage = 'RPV EMITIDO'))"
    ).withColumn("category", F.lower("category")).select(*m.transactions().columns)
    parts = incremental.replace_in_scope(
        m.transactions(), source, m.cases().filter("step = 'JUDICIAL'"), "case_id", ["entry_id"]
    )
    shown = [
        parts["state"].select(F.lit("state").alias("part"), "entry_id", "category"),
        parts["deleted"].select(F.lit("deleted").alias("part"), "entry_id", F.lit("").alias("category")),
        parts["foreign"].select(F.lit("foreign").alias("part"), "entry_id", "category"),
    ]
    return reduce(DataFrame.unionByName, shown)


@query(
    "i12_latest_movement",
    "part s, case_id l, movement_id l",
    """WITH judicial AS (SELECT case_id FROM cases WHERE step = 'JUDICIAL'),
         source AS (SELECT case_id, movement_id + 1000000000 AS movement_id, occurred_at FROM movements WHERE title <> 'view'),
         last AS (SELECT case_id, movement_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at DESC, movement_id DESC) AS rn
           FROM source WHERE case_id IN (SELECT case_id FROM judicial)) WHERE rn = 1)
       SELECT 'state' AS part, case_id, movement_id FROM movements WHERE case_id NOT IN (SELECT case_id FROM judicial)
       UNION ALL SELECT 'state', case_id, movement_id FROM last
       UNION ALL SELECT 'deleted', case_id, movement_id FROM movements WHERE case_id IN (SELECT case_id FROM judicial)
       UNION ALL SELECT 'foreign', case_id, movement_id FROM source WHERE case_id NOT IN (SELECT case_id FROM judicial)""",
)
def i12_movements(m):
    """New movements replace those of judicial cases; of each case only the last one survives."""
    source = m.movements().filter("title <> 'view'").withColumn("movement_id", F.col("movement_id") + 1000000000)
    order = [F.col("occurred_at").desc(), F.col("movement_id").desc()]
    parts = incremental.replace_in_scope(
        m.movements(), source, m.cases().filter("step = 'JUDICIAL'"), "case_id", ["case_id", "movement_id"], order
    )
    return reduce(
        DataFrame.unionByName,
        [parts[p].select(F.lit(p).alias("part"), "case_id", "movement_id") for p in ("state", "deleted", "foreign")],
    )


@query(
    "i13_updated_after",
    "source s, rows l",
    f"""SELECT * FROM (SELECT 'cases' AS source, count(*) AS rows FROM cases WHERE opened_on > TIMESTAMP '{NOW}'
        UNION ALL SELECT 'movements', count(*) FROM movements WHERE occurred_at > TIMESTAMP '{NOW}') WHERE rows > 0""",
)
def i13(m):
    return incremental.updated_after(
        NOW,
        cases=m.cases().withColumn("updated_at", F.col("opened_on").cast("timestamp")),
        movements=m.movements().withColumn("updated_at", F.col("occurred_at")),
    )


@query(
    "i13_stale_inputs",
    "run_id l, source s, last_change t",
    """WITH owned AS (SELECT partner_id, case_id FROM eligible), changes AS (
         SELECT 'cases' AS source, partner_id, opened_on::TIMESTAMP AS updated_at FROM owned JOIN cases USING (case_id)
         UNION ALL SELECT 'bridge', partner_id, opened_on::TIMESTAMP + INTERVAL 1 DAY FROM owned JOIN cases USING (case_id) JOIN case_customers USING (case_id)
         UNION ALL SELECT 'customers', partner_id, opened_on::TIMESTAMP + to_days(CAST(customer_id % 50 AS INTEGER)) FROM owned JOIN cases USING (case_id)
           JOIN case_customers USING (case_id)
         UNION ALL SELECT 'movements', partner_id, occurred_at FROM owned JOIN movements USING (case_id)),
       last AS (SELECT source, partner_id, max(updated_at) AS last_change FROM changes GROUP BY ALL)
       SELECT r.run_id, source, last_change FROM runs r JOIN batches b USING (batch_id) JOIN last l ON l.partner_id = b.partner_id
       WHERE last_change > snapshot_verified_at""",
)
def i13_stale(m):
    """Cases, their customers, the bridge between them and movements against the snapshot of each run."""
    from folioscope.plans.steps import eligible_cases

    owned = eligible_cases(m).select("partner_id", "case_id")
    cases = owned.join(m.cases().select("case_id", F.col("opened_on").cast("timestamp").alias("opened")), "case_id")
    bridge = cases.join(m.case_customers().select("case_id", "customer_id"), "case_id")

    def later(days):
        return (F.unix_micros("opened") + days * 86_400_000_000).cast("bigint")

    def changed(df, moment):
        return df.select("partner_id", moment.alias("updated_at"))

    runs = m.runs().join(m.batches().select("batch_id", "partner_id"), "batch_id")
    return incremental.stale_inputs(
        runs,
        cases=changed(cases, F.col("opened")),
        bridge=changed(bridge, F.timestamp_micros(later(F.lit(1)))),
        customers=changed(bridge, F.timestamp_micros(later(F.col("customer_id") % 50))),
        movements=changed(owned.join(m.movements().select("case_id", "occurred_at"), "case_id"), F.col("occurred_at")),
    )


AUDIT_NOW = "2026-01-20 06:00:00"
PLAN_SQL = f"""SELECT 'source' AS kind, customer_id AS id FROM customers WHERE status = 'active' AND customer_id IN (SELECT source_id FROM batches
         WHERE state IN ('approved', 'superseded') AND updated_at <= TIMESTAMP '{AUDIT_NOW}' - INTERVAL 30 DAY)
       UNION ALL SELECT 'report', version_id FROM versions WHERE status = 'superseded' AND storage_key IS NOT NULL
         AND generated_at <= TIMESTAMP '{AUDIT_NOW}' - INTERVAL 12 MONTH
       UNION ALL SELECT 'audit', audit_id FROM audit_log WHERE occurred_at <= TIMESTAMP '{AUDIT_NOW}' - INTERVAL 24 MONTH"""


def _sources(m):
    purged = F.when(F.col("status") == "inactive", F.lit("1997-01-01").cast("timestamp"))
    return m.customers().select(F.col("customer_id").alias("source_id"), purged.alias("purged_at"))


def _plan(m):
    return retention.retention_plan(_sources(m), m.batches(), m.versions(), m.audit_log(), AUDIT_NOW)


@query("i14_retention_plan", "kind s, id l", PLAN_SQL)
def i14(m):
    return _plan(m)


@query("i14_retention_counts", "kind s, n l", f"SELECT kind, count(*) AS n FROM ({PLAN_SQL}) GROUP BY 1")
def i14_counts(m):
    return retention.retention_counts(_plan(m))


@query(
    "i15_apply_retention",
    "part s, id l, purged_at t",
    f"""WITH due AS ({PLAN_SQL})
       SELECT 'source' AS part, customer_id AS id, CASE WHEN status = 'inactive' THEN TIMESTAMP '1997-01-01' WHEN customer_id IN
         (SELECT id FROM due WHERE kind = 'source') THEN TIMESTAMP '{AUDIT_NOW}' END AS purged_at FROM customers
       UNION ALL SELECT 'report', version_id, CASE WHEN version_id IN (SELECT id FROM due WHERE kind = 'report') THEN TIMESTAMP '{AUDIT_NOW}' END FROM versions
       UNION ALL SELECT 'audit', audit_id, NULL FROM audit_log WHERE audit_id NOT IN (SELECT id FROM due WHERE kind = 'audit')""",
)
def i15(m):
    parts = retention.apply_retention(_plan(m), _sources(m), m.versions(), m.audit_log(), AUDIT_NOW)
    shown = [
        parts["sources"].select(F.lit("source").alias("part"), F.col("source_id").alias("id"), "purged_at"),
        parts["reports"].select(F.lit("report").alias("part"), F.col("version_id").alias("id"), "purged_at"),
        parts["audit"].select(F.lit("audit").alias("part"), F.col("audit_id").alias("id"), F.lit(None).cast("timestamp").alias("purged_at")),
    ]
    return reduce(DataFrame.unionByName, shown)


@query(
    "i16_restore_version",
    "version_id l, status s",
    """WITH cut AS (SELECT partner_id, arg_max(version_id, (generated_at, version_id)) AS id, max(generated_at) AS gen FROM versions
         WHERE status = 'superseded' AND storage_key IS NOT NULL AND generated_at < TIMESTAMP '1998-01-01' GROUP BY 1)
       SELECT version_id, CASE WHEN version_id = id THEN 'validated' WHEN status IN ('validated', 'published') AND generated_at > gen
         THEN 'superseded' ELSE status END AS status FROM versions LEFT JOIN cut USING (partner_id)""",
)
def i16(m):
    """Restores the last superseded version of each partner from before 1998."""
    targets = m.versions().filter("status = 'superseded' and generated_at < timestamp'1998-01-01'")
    return incremental.restore_version(m.versions(), targets)


@query(
    "i17_expire",
    "rule s, link_id l",
    f"""WITH timed AS (SELECT link_id, CASE WHEN link_id % 5 = 0 THEN NULL WHEN link_id % 5 = 1 THEN TIMESTAMP '{NOW}' ELSE expires_at END AS ends
         FROM access_links)
       SELECT 'window' AS rule, link_id FROM timed WHERE ends IS NULL OR ends >= TIMESTAMP '{NOW}'
       UNION ALL SELECT 'session', link_id FROM timed WHERE ends IS NULL OR ends > TIMESTAMP '{NOW}'""",
)
def i17(m):
    """Links without an end, links that end exactly then, and others, under both rules."""
    fifth = F.col("link_id") % 5
    ends = F.when(fifth == 1, F.lit(NOW).cast("timestamp")).when(fifth != 0, F.col("expires_at"))
    timed = m.access_links().withColumn("ends", ends)
    rules = {"window": True, "session": False}
    return reduce(
        DataFrame.unionByName,
        [retention.expire(timed, "ends", NOW, equal).select(F.lit(rule).alias("rule"), "link_id") for rule, equal in rules.items()],
    )


# -- profiles and content scans ---------------------------------------------------------------

#: Cases with arrays longer than any sample would be, the odd element last, and with texts that aren't JSON.
LONG_RAW = """(SELECT raw FROM raw_cases UNION ALL SELECT CASE WHEN seq % 3 = 0 THEN '{"broken": ' || seq ELSE
         '{"items": [' || array_to_string(list_transform(range(25 + seq % 7), lambda x: CAST(x AS VARCHAR)), ',') || ',{"partner_id":"p' || seq || '"}]}' END
         FROM raw_cases)"""
PROFILE_SQL = """SELECT path, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS observed, count_if(type = 'null') AS nulls
       FROM (SELECT regexp_replace(regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g') AS path,
         CASE t.type WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string'
           ELSE lower(t.type) END AS type FROM {raw} r, json_tree(CASE WHEN json_valid(r.raw) THEN r.raw::JSON END) t WHERE t.fullkey <> '$'
         UNION ALL SELECT '', 'malformed' FROM {raw} r WHERE NOT json_valid(r.raw)) GROUP BY 1"""


def _longer():
    """A text with a long array or cut off in the middle, by the number of a case."""
    seq = F.col("seq").cast("string")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), 24 + F.col("seq") % 7), lambda x: x.cast("string")), ",")
    longer = F.concat(F.lit('{"items": ['), numbers, F.lit(',{"partner_id":"p'), seq, F.lit('"}]}'))
    return F.when(F.col("seq") % 3 == 0, F.concat(F.lit('{"broken": '), seq)).otherwise(longer)


def _long_raw(m):
    """The cases, and as many texts with a long array or cut off in the middle."""
    raw = m.raw_cases().select("seq", "raw")
    return raw.select("raw").unionByName(raw.select(_longer().alias("raw")))


@query("q1_schema_profile", "path s, types s, observed l, nulls l", PROFILE_SQL.format(raw=LONG_RAW))
def q1(m):
    return profile.schema_profile(_long_raw(m), "raw").withColumn("types", F.array_join("types", ","))


@query(
    "q2_field_roles",
    "path s, is_id b, is_date b, is_relationship b, has_nulls b, is_partner_candidate b",
    f"""SELECT path, leaf = 'id' OR suffix(leaf, '_id') OR suffix(leaf, '_ids') AS is_id,
         regexp_matches(leaf, '{"|".join(profile.DATE_TERMS)}') AS is_date,
         leaf = 'id' OR suffix(leaf, '_id') OR suffix(leaf, '_ids') OR regexp_matches(leaf, '(customer|lawsuit|user|owner)$') AS is_relationship,
         nulls > 0 AS has_nulls, regexp_matches(lower(path), '{"|".join(profile.PARTNER_TERMS)}')
           AS is_partner_candidate
       FROM (SELECT *, lower(string_split(regexp_replace(path, '\\[\\]$', ''), '.')[-1]) AS leaf FROM ({PROFILE_SQL.format(raw=LONG_RAW)}))""",
)
def q2(m):
    return profile.field_roles(profile.schema_profile(_long_raw(m), "raw"))


def _with_partner(raw):
    """Records of which some name a partner, in one of several shapes."""
    last = F.expr("substring(raw, 1, length(raw) - 1)")
    shape = F.pmod(F.col("seq"), F.lit(5))
    return raw.withColumn(
        "raw",
        F.when(shape == 1, F.concat(last, F.lit(',"extra":{"partner":{"id":7}}}')))
        .when(shape == 2, F.concat(last, F.lit(',"Partner-Id":null}')))
        .when(shape == 3, F.concat(last, F.lit(',"partner":"name only"}')))
        .otherwise(F.col("raw")),
    )


@query(
    "q3_linkage_conclusion",
    "input s, conclusion s, evidence s",
    f"""WITH partner AS (SELECT CASE seq % 5 WHEN 1 THEN raw[:-2] || ',"extra":{{"partner":{{"id":7}}}}}}'
           WHEN 2 THEN raw[:-2] || ',"Partner-Id":null}}' WHEN 3 THEN raw[:-2] || ',"partner":"name only"}}' ELSE raw END AS raw FROM raw_cases),
         hits AS (SELECT input, path FROM (
           SELECT 'plain' AS input, * FROM ({PROFILE_SQL.format(raw="raw_cases")}) UNION ALL
           SELECT 'partner', * FROM ({PROFILE_SQL.format(raw="partner")}) UNION ALL
           SELECT 'long', * FROM ({PROFILE_SQL.format(raw=LONG_RAW)}))
           WHERE regexp_matches(lower(path), '(partner_id|partnerid|parceiro_id|partner\\.id|parceiro\\.id)$') AND nulls < observed)
       SELECT i.input, CASE WHEN count(path) > 0 THEN 'CONFIRMADO' ELSE 'INCONCLUSIVO' END AS conclusion,
         coalesce(string_agg('lawsuits: ' || path, ',' ORDER BY path), '') AS evidence
       FROM (SELECT unnest(['plain', 'partner', 'long']) AS input) i LEFT JOIN hits h ON i.input = h.input GROUP BY 1""",
)
def q3(m):
    """The plain cases, cases that name partners, and cases with a partner at the end of a long array."""
    cases = dealt(m.raw_cases().select("seq", "raw"), "seq")
    texts = _with_partner(cases.withColumn("plain", F.col("raw"))).withColumnRenamed("raw", "partner").withColumn("more", _longer())
    # The cases count for two inputs and are opened once; a path of both columns of an input counts once for it.
    profiles = profile.schema_profiles(texts, "plain", "partner", "more").withColumn("resource", F.lit("lawsuits"))
    inputs = [("plain", "plain"), ("partner", "partner"), ("long", "plain"), ("long", "more")]
    found = m.spark.createDataFrame(inputs, "input string, column string").join(profiles, "column", "left")
    of_input = found.groupBy("input", "resource", "path").agg(F.sum("observed").alias("observed"), F.sum("nulls").alias("nulls"))
    concluded = profile.linkage_conclusion(of_input, "input")
    return concluded.withColumn("evidence", F.array_join("evidence", ","))


@query("q4_direct_partner_field", "seq l, direct b", "SELECT seq, seq % 5 IN (1, 2) AS direct FROM raw_cases")
def q4(m):
    return profile.with_direct_partner(_with_partner(m.raw_cases()), "raw").select("seq", "direct")


def _re2(pattern: str) -> str:
    """A pattern without look-around and Unicode word ends, for an engine that has neither."""
    word_end, letters = r"[^\pL\pM\pN_]", r"\w"
    pattern = pattern.replace(r"(?<!\d)", "(^|[^0-9])").replace(r"(?!\d)", "([^0-9]|$)").replace(r"\d", "[0-9]").replace("(?iuU)", "(?i)")
    if pattern.startswith(r"(?i)\b"):
        pattern = "(?i)(^|" + word_end + ")" + pattern[6:-2] + "(" + word_end + "|$)"
    return pattern.replace(letters, r"[\pL\pM\pN_]")


def scan_sql(text: str) -> str:
    checks = [f"CASE WHEN regexp_matches({text}, '{_re2(p)}') THEN '{code}' END" for code, p in sorted(profile.SENSITIVE.items())]
    return f"concat_ws(',', {', '.join(checks)})"


@query("q5_scan_documents", "doc_id l, findings s", f"SELECT doc_id, {scan_sql('text')} AS findings FROM documents")
def q5(m):
    return profile.scan_sensitive(m.stored("documents"), ["text"]).withColumn("findings", F.array_join("findings", ","))


@query(
    "q5_quarantine_pages",
    "side s, page_id l, findings s",
    f"""SELECT CASE WHEN findings = '' THEN 'clean' ELSE 'quarantine' END AS side, page_id, findings
        FROM (SELECT page_id, {scan_sql("(url || chr(10) || html)")} AS findings FROM pages)""",
)
def q5_pages(m):
    return profile.quarantine(m.stored("pages"), ["url", "html"]).withColumn("findings", F.array_join("findings", ","))


@query(
    "q5_scan_nested",
    "conv_id l, findings s",
    f"""SELECT conv_id, {scan_sql("string_agg(role || chr(10) || text || chr(10) || key, chr(10))")} AS findings
        FROM (SELECT conv_id, role, CASE turn WHEN 1 THEN 'CPF 123.456.789-0' || (conv_id % 10) WHEN 2 THEN 'diagnóstico' WHEN 3 THEN 'sk-abcdefghijkl'
                ELSE text END AS text, CASE WHEN conv_id % 4 = 1 THEN 'senha' ELSE 'plain' END AS key FROM conversations) GROUP BY 1""",
)
def q5_nested(m):
    """Conversations as nested values, with blocked content in some texts and some map keys."""
    text = (
        F.when(F.col("turn") == 1, F.concat(F.lit("CPF 123.456.789-0"), (F.col("conv_id") % 10).cast("string")))
        .when(F.col("turn") == 2, "diagnóstico")
        .when(F.col("turn") == 3, "sk-abcdefghijkl")
        .otherwise(F.col("text"))
    )
    key = F.when(F.col("conv_id") % 4 == 1, "senha").otherwise("plain")
    nested = m.stored("conversations").groupBy("conv_id").agg(
        F.collect_list(F.struct("role", text.alias("content"))).alias("turns"),
        F.create_map(F.max(key), F.count(F.lit(1))).alias("counts"),
    )
    return profile.scan_sensitive(nested, ["turns", "counts"]).withColumn("findings", F.array_join("findings", ","))


@query(
    "q6_consistency",
    "report_id l, violations s",
    f"""SELECT partner_id AS report_id, concat_ws(',', CASE WHEN status <> 'active' THEN 'required_unavailable' END,
         CASE WHEN partner_id % 7 = 3 THEN 'origin' END, CASE WHEN partner_id % 5 = 2 THEN 'counts' END,
         CASE WHEN partner_id % 6 = 1 THEN 'unapproved_available' END,
         CASE WHEN partner_id = 4 THEN 'reference_shape' END) AS violations FROM partners JOIN ({QUALITY_SQL}) USING (partner_id)""",
)
def q6(m):
    """Reports of all partners with some fields made wrong, and references of all eligible cases."""
    from folioscope.plans.steps import eligible_cases

    cases = eligible_cases(m)
    wrong = F.when(F.col("partner_id") == 4, F.lit("X-")).otherwise(F.lit("L-"))
    refs = cases.select(
        F.col("partner_id").alias("report_id"),
        F.lit("case").alias("kind"),
        F.concat(wrong, F.lpad(F.col("case_id").cast("string"), 12, "0")).alias("reference"),
    )
    p = F.col("partner_id")

    def wrapped(status, value, source):
        return F.struct(status.alias("status"), value.alias("value"), F.lit(source).alias("source"))

    ok, pending = F.lit("available"), F.lit("pending_validation")
    state = F.when(F.col("status") == "active", ok).otherwise(pending)
    owned = quality(m).join(m.partners().select("partner_id", "status"), "partner_id")
    n_cases = F.col("eligible_cases") + F.when(p % 5 == 2, 1).otherwise(0)
    link = consistency.LINK_SOURCE
    fields = {
        "partner": wrapped(state, F.lit("code"), link),
        "summary": wrapped(ok, F.lit("x"), link),
        "unique_customers": wrapped(ok, F.lit(0), link),
        "cases": wrapped(ok, n_cases, link),
        "customer_list": wrapped(ok, F.lit("x"), link),
        "case_list": wrapped(ok, F.lit("x"), link),
        "origin": wrapped(ok, F.when(p % 7 == 3, "other").otherwise(consistency.ORIGIN_VALUE), consistency.ORIGIN_SOURCE),
        "metadata": wrapped(ok, F.lit(consistency.RULE_VERSION), consistency.METADATA_SOURCE),
        **{n: wrapped(pending, F.lit(None).cast("string"), "business_rules") for n in consistency.UNAPPROVED},
        "financial": wrapped(F.when(p % 6 == 1, ok).otherwise(pending), F.lit(None).cast("string"), "business_rules"),
    }
    reports = owned.select(p.alias("report_id"), *[c.alias(n) for n, c in fields.items()])
    return consistency.consistency_violations(reports, refs).withColumn("violations", F.array_join("violations", ","))
