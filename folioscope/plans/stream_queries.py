"""Streaming queries: the stored event table is read as a stream and drained once."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.registry import query
from folioscope.plans.steps import AS_OF, LINK_DAY
from folioscope.session import state_in_rocksdb, work_folder
from folioscope.sources.tables import SCHEMAS
from folioscope.streaming import jobs, limiter, sync


def event_stream(m) -> DataFrame:
    """The event table as a stream; the pattern lets it be one file or a folder of files."""
    return m.spark.readStream.schema(SCHEMAS["events"]).parquet(f"{m.path.rstrip('/')}/events.parque[t]")


def _movements(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("case_id"),
        F.col("ts").alias("occurred_at"),
        F.col("event_type").alias("title"),
        F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH"), "event_type").alias("fingerprint"),
        F.col("event_id").alias("movement_id"),
    )


@query(
    "st1_stream_movements",
    "part s, case_id l, fingerprint s",
    """SELECT DISTINCT CASE WHEN case_id IN (SELECT case_id FROM cases) THEN 'new' ELSE 'missing_lawsuit' END AS part, case_id,
         concat_ws('|', strftime(ts, '%Y-%m-%d %H'), event_type) AS fingerprint
       FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN user_id + 1000000000 ELSE user_id END AS case_id FROM events)""",
)
def st1(m):
    """One movement in 17 names a case that nobody knows."""
    lost = F.when(F.col("event_id") % 17 == 0, F.col("user_id") + 1000000000).otherwise(F.col("user_id"))
    folder = work_folder(m.spark, "movements")
    new, errors = f"{folder}/table", f"{folder}/errors"
    jobs.stream_movements(_movements(event_stream(m).withColumn("user_id", lost)), m.cases(), new, errors, f"{folder}/checkpoint").awaitTermination()
    parts = [m.spark.read.parquet(p).select(F.lit(n).alias("part"), "case_id", "fingerprint") for n, p in (("new", new), ("missing_lawsuit", errors))]
    return parts[0].unionByName(parts[1])


def _in_batches(batches: list[DataFrame], folder: str, run) -> None:
    """Appends each frame to a folder and drains ``run(stream)``, so that each is one micro-batch."""
    for rows in batches:
        rows.write.mode("append").parquet(folder)
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(folder)
        run(stream).awaitTermination()


@query(
    "st2_stream_upsert",
    "key l, row_hash s, action s",
    """WITH newest AS (SELECT user_id AS key, event_id % 3 AS batch, sha256(concat_ws('|', user_id, event_type)) AS row_hash,
         row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, sha256(concat_ws('|', user_id, event_type)) DESC) AS rn FROM events),
       steps AS (SELECT *, lag(row_hash) OVER (PARTITION BY key ORDER BY batch) AS stored FROM newest WHERE rn = 1),
       changes AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY batch DESC) AS last FROM steps WHERE row_hash IS DISTINCT FROM stored)
       SELECT key, row_hash, CASE WHEN stored IS NULL THEN 'insert' ELSE 'update' END AS action FROM changes WHERE last = 1""",
)
def st2(m):
    """Three micro-batches: keys are inserted, updated or kept."""
    folder = work_folder(m.spark, "upsert")
    hashed = F.sha2(F.concat_ws("|", "user_id", "event_type"), 256).alias("row_hash")
    rows = m.stored("events").select("event_id", F.col("user_id").alias("key"), "ts", hashed)
    parts = [rows.filter(F.col("event_id") % 3 == part).drop("event_id") for part in range(3)]
    _in_batches(
        parts,
        f"{folder}/in",
        lambda stream: jobs.stream_upsert(stream, "key", "row_hash", "ts", f"{folder}/log", f"{folder}/checkpoint"),
    )
    return jobs.current_state(m.spark, f"{folder}/log", parts[0].schema, "key")


def sync_batches(m) -> list[DataFrame]:
    """Three runs: the stored tables arrive in parts, and later parts repeat and change earlier records."""
    nothing = {"id": "bigint", "case_id": "bigint", "fingerprint": "string", "customers": "array<bigint>"}

    def records(rows, resource, row_hash, **columns):
        filled = [columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in nothing.items()]
        offset = (F.floor(columns.get("id", columns.get("case_id")) / 100) * 100).cast("bigint").alias("page_offset")
        return rows.select(F.lit(resource).alias("resource"), *filled, row_hash.alias("row_hash"), offset, F.lit("{}").alias("body"))

    def of(run):
        c = F.col("customer_id")
        here = {0: c % 4 != 3, 1: c % 4 >= 2, 2: c % 5 == 0}[run]
        changed = F.when((c % 8 == 2) & F.lit(run > 0), "changed").otherwise("first")
        customers = records(m.customers().filter(here), "customers", changed, id=c)

        k = F.col("case_id")
        shown = m.case_customers().filter((F.col("customer_id") % 3 != 1) | F.lit(run < 2))
        listed = shown.groupBy("case_id").agg(F.collect_set("customer_id").alias("listed"))
        cases = m.cases().join(listed, "case_id", "left").filter({0: k % 3 != 0, 1: k % 3 == 0, 2: k % 2 == 0}[run])
        stage = F.when((k % 10 == 4) & F.lit(run == 2), "later").otherwise(F.col("stage"))
        lawsuits = records(cases, "lawsuits", stage, id=k, customers=F.coalesce("listed", F.array()))

        e = F.col("entry_id")
        moved = F.when((e % 7 == 0) & F.lit(run == 2), k + 1).otherwise(k)
        entries = m.transactions().filter({0: e % 2 == 0, 1: e % 2 == 1, 2: e % 7 == 0}[run])
        transactions = records(entries, "transactions", F.col("category"), id=e, case_id=moved)

        seen = m.movements().filter((F.col("movement_id") % 3 == run) | (F.lit(run == 2) & (F.col("movement_id") % 3 == 0)))
        print_ = F.concat_ws("|", F.to_date("occurred_at"), "title")
        movements = records(seen, "movements", F.lit(""), case_id=k, fingerprint=print_)
        return customers.unionByName(lawsuits).unionByName(transactions).unionByName(movements)

    return [of(run) for run in range(3)]


SYNC_SQL = """WITH runs AS (SELECT unnest([0, 1, 2]) AS run),
       customer_in AS (SELECT run, customer_id, CASE WHEN run > 0 AND customer_id % 8 = 2 THEN 'changed' ELSE 'first' END AS row_hash
         FROM customers, runs WHERE (run = 0 AND customer_id % 4 <> 3) OR (run = 1 AND customer_id % 4 >= 2) OR (run = 2 AND customer_id % 5 = 0)),
       customer_step AS (SELECT *, lag(row_hash) OVER (PARTITION BY customer_id ORDER BY run) AS stored FROM customer_in),
       customer_out AS (SELECT run, customer_id, CASE WHEN stored IS NULL THEN 'insert' ELSE 'update' END AS action FROM customer_step
         WHERE row_hash IS DISTINCT FROM stored),
       customer_known AS (SELECT customer_id, min(run) AS since FROM customer_in GROUP BY 1),
       case_in AS (SELECT run, case_id, CASE WHEN run = 2 AND case_id % 10 = 4 THEN 'later' ELSE stage END AS row_hash
         FROM cases, runs WHERE (run = 0 AND case_id % 3 <> 0) OR (run = 1 AND case_id % 3 = 0) OR (run = 2 AND case_id % 2 = 0)),
       case_known AS (SELECT case_id, min(run) AS since FROM case_in GROUP BY 1),
       case_step AS (SELECT *, lag(row_hash) OVER w AS stored, lag(run) OVER w AS before, lead(run) OVER w AS after FROM case_in
         WINDOW w AS (PARTITION BY case_id ORDER BY run)),
       pair_in AS (SELECT c.run, c.case_id, p.customer_id, c.before, c.after FROM case_step c JOIN (SELECT DISTINCT * FROM case_customers) p USING (case_id)
         WHERE c.run < 2 OR p.customer_id % 3 <> 1),
       wanted AS (SELECT p.* FROM pair_in p JOIN customer_known k ON k.customer_id = p.customer_id AND k.since <= p.run),
       pair_out AS (SELECT w.run, w.case_id, w.customer_id, 'add' AS action FROM wanted w
           LEFT JOIN wanted o ON o.case_id = w.case_id AND o.customer_id = w.customer_id AND o.run = w.before WHERE o.run IS NULL
         UNION ALL SELECT w.after, w.case_id, w.customer_id, 'delete' FROM wanted w
           LEFT JOIN wanted n ON n.case_id = w.case_id AND n.customer_id = w.customer_id AND n.run = w.after WHERE w.after IS NOT NULL AND n.run IS NULL),
       bridge AS (SELECT r.run, w.case_id, w.customer_id FROM wanted w JOIN runs r ON r.run >= w.run AND r.run < coalesce(w.after, 3)),
       entry_in AS (SELECT run, entry_id, category AS row_hash, CASE WHEN run = 2 AND entry_id % 7 = 0 THEN case_id + 1 ELSE case_id END AS named
         FROM transactions, runs WHERE (run = 0 AND entry_id % 2 = 0) OR (run = 1 AND entry_id % 2 = 1) OR (run = 2 AND entry_id % 7 = 0)),
       entry_step AS (SELECT e.*, k.case_id, lag(e.run) OVER w AS before, lag(k.case_id) OVER w AS stored_case, lag(e.row_hash) OVER w AS stored
         FROM entry_in e LEFT JOIN case_known k ON k.case_id = e.named AND k.since <= e.run WINDOW w AS (PARTITION BY entry_id ORDER BY e.run)),
       entry_out AS (SELECT run, entry_id, case_id, stored_case, CASE WHEN before IS NULL THEN 'insert' ELSE 'update' END AS action FROM entry_step
         WHERE before IS NULL OR row_hash IS DISTINCT FROM stored OR case_id IS DISTINCT FROM stored_case),
       movement_in AS (SELECT run, case_id, concat_ws('|', occurred_at::DATE, title) AS fingerprint FROM movements, runs
         WHERE movement_id % 3 = run OR (run = 2 AND movement_id % 3 = 0)),
       movement_out AS (SELECT min(m.run) AS run, m.case_id, fingerprint FROM movement_in m JOIN case_known k ON k.case_id = m.case_id AND k.since <= m.run
         GROUP BY 2, 3),
       case_out AS (SELECT run, case_id, CASE WHEN stored IS NULL THEN 'insert' ELSE 'update' END AS action FROM case_step WHERE row_hash IS DISTINCT FROM stored),
       changed_cases AS (SELECT run, case_id FROM case_out UNION SELECT run, case_id FROM pair_out UNION SELECT run, case_id FROM entry_out
         UNION SELECT run, stored_case FROM entry_out UNION SELECT run, case_id FROM movement_out),
       hit AS (SELECT run, 'customer' AS t, customer_id AS id FROM customer_out
         UNION SELECT run, 'case', case_id FROM bridge SEMI JOIN customer_out USING (run, customer_id)
         UNION SELECT run, 'case', case_id FROM changed_cases
         UNION SELECT run, 'customer', customer_id FROM bridge SEMI JOIN changed_cases USING (run, case_id)),
       lost AS (SELECT run, 'missing_customer' AS code, customer_id AS id FROM pair_in p WHERE NOT EXISTS (FROM customer_known k WHERE k.customer_id = p.customer_id AND k.since <= p.run)
         UNION ALL SELECT run, 'missing_lawsuit', named FROM entry_step WHERE named IS NOT NULL AND case_id IS NULL
         UNION ALL SELECT run, 'missing_lawsuit', case_id FROM movement_in m WHERE NOT EXISTS (FROM case_known k WHERE k.case_id = m.case_id AND k.since <= m.run))"""


@query(
    "st2_sync_runs",
    "run l, part s, key s, detail s",
    f"""{SYNC_SQL}
       SELECT run, 'customer' AS part, customer_id::VARCHAR AS key, action AS detail FROM customer_out
       UNION ALL SELECT run, 'case', case_id::VARCHAR, action FROM case_out
       UNION ALL SELECT run, 'pair', concat_ws('|', case_id, customer_id), action FROM pair_out
       UNION ALL SELECT run, 'transaction', concat_ws('|', entry_id, case_id), action FROM entry_out
       UNION ALL SELECT run, 'movement', concat_ws('|', case_id, fingerprint), 'insert' FROM movement_out
       UNION ALL SELECT run, 'error', concat_ws('|', code, id), count(*)::VARCHAR FROM lost GROUP BY 1, code, id
       UNION ALL SELECT DISTINCT run, 'partner', partner_id::VARCHAR, 'changed' FROM active_links JOIN hit ON t = entity_type AND id = entity_id""",
)
def st2_sync(m):
    """What each of three runs changed in every table, its errors, and the partners it touched."""
    folder = work_folder(m.spark, "sync")
    _in_batches(
        sync_batches(m),
        f"{folder}/in",
        lambda stream: sync.stream_sync(stream, m.links(), LINK_DAY, f"{folder}/tables", f"{folder}/checkpoint", 4),
    )
    t = sync.SyncTables(m.spark, f"{folder}/tables", 2, 4)

    def part(name, log, *key, detail=F.col("action")):
        rows = reduce(DataFrame.unionByName, [t[log].changes(run) for run in range(3)])
        return rows.select(F.col("batch").alias("run"), F.lit(name).alias("part"), F.concat_ws("|", *key).alias("key"), detail.alias("detail"))

    lost = part("error", "errors", "error_code", "reference").groupBy("run", "part", "key")
    return reduce(
        DataFrame.unionByName,
        [
            part("customer", "customers", "customer_id"),
            part("case", "cases", "case_id"),
            part("pair", "pairs_by_case", "case_id", "customer_id"),
            part("transaction", "transactions", "entry_id", "case_id"),
            part("movement", "movements", "case_id", "fingerprint"),
            lost.agg(F.count(F.lit(1)).cast("string").alias("detail")),
            part("partner", "partners", "partner_id", detail=F.lit("changed")),
        ],
    )


LIMITER_SQL = """WITH RECURSIVE timed AS (SELECT user_id::VARCHAR AS key, event_id, make_timestamp(epoch_us(ts) // 256) AS ts, value > 80 AS success FROM events),
       e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM timed),
       walk AS (SELECT key, event_id, rn, ts, success, CASE WHEN success THEN NULL ELSE ts END AS s, CASE WHEN success THEN 0 ELSE 1 END AS f
         FROM e WHERE rn = 1
         UNION ALL SELECT e.key, e.event_id, e.rn, e.ts, e.success,
           CASE WHEN e.success THEN NULL WHEN w.s IS NULL OR e.ts - w.s >= INTERVAL 15 MINUTE THEN e.ts ELSE w.s END,
           CASE WHEN e.success THEN 0 WHEN w.s IS NULL OR e.ts - w.s >= INTERVAL 15 MINUTE THEN 1 ELSE w.f + 1 END
         FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
       SELECT key, event_id, s AS window_start, f AS failures, f >= 5 AS limited FROM walk WHERE NOT success"""
LIMITER_SHAPE = "key s, event_id l, window_start t, failures l, limited b"


def _logins(m) -> DataFrame:
    """Each user logs in, in a time that runs 256 times faster; large values are successes."""
    at = F.timestamp_micros(F.floor(F.unix_micros("ts") / 256).cast("bigint"))
    return m.stored("events").select(
        F.col("user_id").cast("string").alias("key"), at.alias("at"), "event_id", (F.col("value") > 80).alias("success")
    )


@query("st3_failure_limiter", LIMITER_SHAPE, LIMITER_SQL)
def st3(m):
    return limiter.limiter(_logins(m))


@query("st3_live_limiter", LIMITER_SHAPE, LIMITER_SQL)
def st3_live(m):
    """The first third of the time in the batch form, whose open windows the stream takes over in two runs."""
    folder = work_folder(m.spark, "logins")
    logins = _logins(m)
    at = F.unix_micros("at")
    row = logins.agg(F.percentile_approx(at, [1 / 3, 2 / 3]).alias("cuts"), F.max(at).alias("last")).first()
    first, second = row["cuts"] or [0, 0]
    # An event long after all others moves the watermark behind them.
    clock = m.spark.range(1).select(
        F.lit("clock").alias("key"), F.timestamp_micros(F.lit((row["last"] or 0) + 86_400_000_000)).alias("at"),
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(True).alias("success"),
    )
    before = logins.filter(at <= first)
    opened = limiter.open_windows(before)
    later = [logins.filter((at > first) & (at <= second)), logins.filter(at > second).unionByName(clock)]

    def run(stream):
        found = limiter.live_limiter(stream, opened).writeStream.outputMode("append").format("parquet")
        sink = found.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        # The processor has several states per key, which the default store can't hold.
        with state_in_rocksdb(m.spark):
            return sink.start()

    _in_batches(later, f"{folder}/in", run)
    live = m.spark.read.schema(limiter.OUTPUT).parquet(f"{folder}/out")
    return limiter.limiter(before).unionByName(live)


@query(
    "st4_stream_latest",
    "case_id l, last_movement_at t, last_movement_title s",
    f"""SELECT user_id AS case_id, ts AS last_movement_at, event_type AS last_movement_title FROM (SELECT *, row_number() OVER
       (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND user_id IN (SELECT case_id FROM cases)) WHERE rn = 1""",
)
def st4(m):
    folder = work_folder(m.spark, "latest")
    latest = jobs.stream_latest(_movements(event_stream(m)), m.cases(), AS_OF)
    jobs.keep_latest_in_table(latest, "case_id", f"{folder}/log", f"{folder}/checkpoint")
    return jobs.current_state(m.spark, f"{folder}/log", latest.schema, "case_id")


@query(
    "st5_stream_audit_counts",
    "day d, action s, events l",
    """SELECT occurred_at::DATE AS day, action, count(*) AS events FROM audit_log
       WHERE occurred_at::DATE + INTERVAL 1 DAY <= (SELECT max(occurred_at) FROM audit_log) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def st5(m):
    """Only days that the watermark has closed are in the table."""
    folder = work_folder(m.spark, "audit")
    events = event_stream(m).selectExpr(
        "ts as occurred_at",
        """case event_type when 'error' then 'login_failed' when 'view' then 'report_view'
             when 'signup' then 'account_created' when 'click' then 'catalog_view' else 'unknown_action' end as action""",
    )
    jobs.run_to_table(jobs.stream_audit_counts(events), f"{folder}/table", f"{folder}/checkpoint")
    return m.spark.read.parquet(f"{folder}/table")
