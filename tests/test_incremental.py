import datetime as dt
import random

from pyspark.sql import functions as F

from folioscope.operators import incremental, retention, status
from folioscope.streaming import jobs, limiter

NOW = dt.datetime(2026, 9, 25)


def test_second_load_changes_nothing_and_inactive_rows_revive(spark, rows):
    target = spark.createDataFrame([(1, "h1", "active"), (2, "h2", "inactive"), (3, "h3", "active")], "id long, row_hash string, status string")
    source = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "new"), (4, "h4")], "id long, row_hash string")
    state = incremental.upsert(target, source, "id")
    assert rows(state, "id", "action") == [(1, "keep"), (2, "update"), (3, "update"), (4, "insert")]
    again = incremental.upsert(state.drop("action"), source, "id")
    assert {r["action"] for r in again.collect()} == {"keep"}


def test_moved_transaction_marks_both_cases(spark, rows):
    target = spark.createDataFrame([(1, 10, "h"), (2, 11, "h")], "entry_id long, case_id long, row_hash string")
    source = spark.createDataFrame([(1, 11, "h", 0), (2, 11, "h", 0), (3, 99, "h", 100)], "entry_id long, case_id long, row_hash string, page_offset long")
    cases = spark.createDataFrame([(10,), (11,)], "case_id long")
    parts = incremental.upsert_transactions(target, source, cases)
    assert rows(parts["changed_cases"]) == [(10,), (11,)]
    assert rows(parts["errors"], "error_code", "page_offset") == [("missing_lawsuit", 100)]
    assert rows(parts["transactions"], "entry_id", "case_id", "action") == [(1, 11, "update"), (2, 11, "keep"), (3, None, "insert")]


def test_retention_is_idempotent(spark, rows):
    old, recent = NOW - dt.timedelta(days=900), NOW - dt.timedelta(days=1)
    sources = spark.createDataFrame([(1, None), (2, None), (3, old)], "source_id long, purged_at timestamp")
    batches = spark.createDataFrame(
        [(1, "approved", NOW - dt.timedelta(days=30)), (2, "approved", recent), (3, "superseded", old)],
        "source_id long, state string, updated_at timestamp",
    )
    reports = spark.createDataFrame(
        [(1, "superseded", old, "k", None), (2, "validated", old, "k", None), (3, "superseded", recent, "k", None)],
        "version_id long, status string, generated_at timestamp, storage_key string, purged_at timestamp",
    )
    audit = spark.createDataFrame([(1, old), (2, recent)], "audit_id long, occurred_at timestamp")
    plan = retention.retention_plan(sources, batches, reports, audit, NOW)
    assert rows(plan) == [("audit", 1), ("report", 1), ("source", 1)]
    after = retention.apply_retention(plan, sources, reports, audit, NOW)
    assert retention.retention_plan(after["sources"], batches, after["reports"], after["audit"], NOW).count() == 0
    assert rows(after["audit"], "audit_id") == [(2,)]
    assert rows(after["sources"].filter("source_id = 3"), "purged_at") == [(old,)]


def test_run_status_needs_a_full_scan_without_open_errors(spark):
    actions = spark.createDataFrame([("insert",), ("update",), ("keep",), ("absent",)], "action string")
    errors = spark.createDataFrame([(NOW,)], "resolved_at timestamp")
    partners = spark.createDataFrame([(1,)], "partner_id long")
    row = incremental.run_summary(actions, errors, partners, 100, 100).first()
    assert (row["fetched"], row["inserted"], row["updated"], row["errors"], row["status"]) == (3, 1, 1, 0, "succeeded")
    assert incremental.run_summary(actions, errors, partners, 100, 50).first()["status"] == "partial"
    open_errors = errors.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    assert incremental.run_summary(actions, open_errors, partners, 100, 100).first()["status"] == "partial"


def test_transitions(spark, rows):
    events = spark.createDataFrame(
        [
            (1, 0, None, "uploaded"), (1, 7, "uploaded", "quarantined"), (1, 9000, "quarantined", "parsing"), (1, 9001, "parsed", "reconciling"),
            (2, 0, "approved", "parsed"), (3, 1, None, "uploaded"), (3, 3, None, "uploaded"), (4, 0, "uploaded", "quarantined"),
            (5, 0, None, "uploaded"), (5, 1, "uploaded", "quarantined"), (5, 3, "parsing", "parsed"),
        ],
        "batch_id long, seq long, from_state string, to_state string",
    )
    assert rows(status.invalid_transitions(events), "batch_id", "seq", "violation") == [
        (1, 9001, "chain_broken"), (2, 0, "not_allowed"), (3, 3, "not_allowed"), (4, 0, "chain_broken"), (5, 3, "chain_broken"),
    ]


def test_events_without_action_or_entity_are_unlisted(spark, rows):
    events = spark.createDataFrame(
        [(1, None, "user", None), (2, "logout", None, None), (3, "logout", "user", None), (4, "logout", "user", "other")],
        "audit_id long, action string, entity_type string, reason_code string",
    )
    assert rows(status.unlisted_audit(events), "audit_id") == [(1,), (2,), (4,)]


def test_rows_without_an_end_stay(spark, rows):
    cut, earlier = dt.datetime(2026, 1, 1), dt.datetime(2025, 12, 31)
    df = spark.createDataFrame([(1, None), (2, cut), (3, earlier)], "id long, ends timestamp")
    assert rows(retention.expire(df, "ends", cut), "id") == [(1,), (2,)]
    assert rows(retention.expire(df, "ends", cut, equal_stays=False), "id") == [(1,)]


def _login_events(spark):
    start = dt.datetime(2026, 1, 1)
    minutes = [0, 1, 2, 3, 4, 14, 15, 16, 31, 32, 60]
    data = [("a", start + dt.timedelta(minutes=m), i, False) for i, m in enumerate(minutes)]
    data += [("b", start + dt.timedelta(minutes=m), 100 + m, m == 3) for m in range(6)]
    return spark.createDataFrame(data, "key string, at timestamp, event_id long, success boolean")


def test_limiter_window_starts_at_first_failure(spark):
    found = {r["event_id"]: (r["window_start"].minute, r["failures"], r["limited"]) for r in limiter.limiter(_login_events(spark)).collect()}
    assert found[4] == (0, 5, True) and found[5] == (0, 6, True)
    assert found[6] == (15, 1, False) and found[8] == (31, 1, False) and found[10] == (0, 1, False)
    assert found[102][1] == 3 and 103 not in found and found[104][1] == 1


def test_stream_twins(spark, rows, tmp_path):
    """Three files arrive one by one; the streams end where the batch jobs end."""
    schema = "case_id long, occurred_at timestamp, title string, fingerprint string, movement_id long"
    base = dt.datetime(2026, 1, 1)
    data = [(i % 4, base + dt.timedelta(hours=i), "t", f"f{i % 5}", i) for i in range(30)]
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(data[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(source)
    cases = spark.createDataFrame([(0,), (1,), (2,)], "case_id long")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    query = jobs.stream_movements(stream(), cases, str(tmp_path / "m"), str(tmp_path / "me"), str(tmp_path / "cm"))
    query.awaitTermination()
    whole = spark.createDataFrame(data, schema).withColumn("page_offset", F.lit(0))
    batch = incremental.append_movements(whole.limit(0), whole, cases)["new"]
    keys = ("case_id", "fingerprint")
    assert rows(spark.read.parquet(str(tmp_path / "m")), *keys) == rows(batch, *keys)

    lost = incremental.append_movements(whole.limit(0), whole, cases)["errors"]
    assert rows(spark.read.parquet(str(tmp_path / "me")).select("case_id").distinct()) == rows(lost.select("case_id").distinct())

    newest = jobs.stream_latest(stream(), cases)
    jobs.keep_latest_in_table(newest, "case_id", str(tmp_path / "l"), str(tmp_path / "cl"))
    latest = jobs.current_state(spark, str(tmp_path / "l"), newest.schema, "case_id")
    assert rows(latest, "case_id", "last_movement_at") == rows(jobs.stream_latest(whole, cases), "case_id", "last_movement_at")

    hashed = stream().select("case_id", "occurred_at", F.col("fingerprint").alias("row_hash"))
    jobs.stream_upsert(hashed, "case_id", "row_hash", "occurred_at", str(tmp_path / "u"), str(tmp_path / "cu")).awaitTermination()
    state = jobs.current_state(spark, str(tmp_path / "u"), hashed.schema, "case_id")
    wanted = whole.groupBy("case_id").agg(F.max_by("fingerprint", "occurred_at").alias("row_hash"))
    assert rows(state, "case_id", "row_hash") == rows(wanted, "case_id", "row_hash")


def _drained(stream, folder):
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_live_limiter_equals_batch(spark, rows, tmp_path):
    """Three files in turn, each in no order; the windows of the events before them are handed over."""
    random.seed(6)
    start = dt.datetime(2026, 1, 1)
    data, seconds = [], 0
    for i in range(600):
        seconds += random.choice([0, 1, 5, 40, 200, 901])
        data.append((random.choice("abcc"), start + dt.timedelta(seconds=seconds, microseconds=random.randrange(3)), i, random.random() < 0.1))
    schema = "key string, at timestamp, event_id long, success boolean"
    clock = [("clock", start + dt.timedelta(seconds=seconds, days=1), -1, True)]
    for name, handed in (("whole", 0), ("handed", 150)):
        folder = str(tmp_path / name)
        before = spark.createDataFrame(data[:handed], schema)
        for part in (data[handed:300], data[300:450], data[450:] + clock):
            spark.createDataFrame(random.sample(part, len(part)), schema).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            opened = limiter.open_windows(before) if handed else None
            _drained(limiter.live_limiter(stream, opened), folder)
        columns = ("key", "event_id", "window_start", "failures", "limited")
        whole = limiter.limiter(spark.createDataFrame(data, schema)).filter(F.col("event_id") >= handed)
        assert rows(spark.read.parquet(f"{folder}/out"), *columns) == rows(whole, *columns)


def test_movements_of_any_age_are_kept_once(spark, rows, tmp_path):
    """Each batch is one file; later ones bring rows years behind the newest, and copies."""
    at = lambda day: dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
    schema = "case_id long, occurred_at timestamp, title string, fingerprint string, movement_id long"
    batches = [
        [(1, at(0), "t", "a", 1), (1, at(0), "t", "a", 2), (9, at(0), "t", "x", 3)],
        [(1, at(-900), "t", "old", 4), (9, at(-900), "t", "old", 5), (1, None, "t", "no day", 6)],
        [(1, at(-900), "t", "old", 7), (9, at(0), "t", "x", 8), (1, at(0), "t", "a", 9), (1, None, "t", "no day", 10), (2, at(-30), "t", "b", 11)],
    ]
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    names = [str(tmp_path / n) for n in ("in", "new", "errors", "checkpoint")]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(names[0])
        stream = spark.readStream.schema(schema).parquet(names[0])
        jobs.stream_movements(stream, cases, *names[1:]).awaitTermination()
    assert rows(spark.read.parquet(names[1]), "case_id", "fingerprint") == [(1, "a"), (1, "no day"), (1, "old"), (2, "b")]
    assert rows(spark.read.parquet(names[2]), "case_id", "fingerprint") == [(9, "old"), (9, "x")]
