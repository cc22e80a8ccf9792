"""The sync stream against the batch operators, run after run, and what a lookup reads."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from folioscope.operators import incremental
from folioscope.operators import links as link_ops
from folioscope.streaming import sync
from folioscope.streaming.keyed_log import MOST_SEGMENTS, KeyedLog, Ledger

DAY = "2026-01-01"
LINKS = "link_id long, partner_id long, entity_type string, entity_id long, valid_from date, valid_to date, status string"
EMPTY = {
    "customers": "customer_id long, row_hash string, body string, status string",
    "cases": "case_id long, row_hash string, body string, status string",
    "bridge": "case_id long, customer_id long",
    "transactions": "entry_id long, case_id long, row_hash string, body string",
    "movements": "case_id long, fingerprint string, body string",
}


def records(seed):
    random.seed(seed)
    rows = [("customers", i, None, None, None, f"h{random.randrange(2)}", 0, "{}") for i in random.sample(range(1, 30), 12)]
    for i in random.sample(range(1, 25), 9):
        rows.append(("lawsuits", i, None, None, random.sample(range(1, 34), 2), f"h{random.randrange(2)}", 0, "{}"))
    for i in random.sample(range(1, 40), 14):
        rows.append(("transactions", i, random.choice([None, *range(1, 28)]), None, None, f"h{random.randrange(2)}", 100, "{}"))
    rows += [("movements", None, random.randrange(1, 28), f"f{random.randrange(9)}", None, "", 0, "{}") for _ in range(12)]
    # Two records of one key: the one of the later page counts.
    return [*rows, (*rows[0][:5], "early", -100, "{}"), ("customers", None, None, None, None, "no id", 0, "{}")]


def batch_run(spark, state, rows, links, run):
    """One run with the batch operators over whole tables; the next state and the partners."""
    source = spark.createDataFrame(rows, sync.RECORD).filter("page_offset >= 0")
    of = lambda name: source.filter(F.col("resource") == name)
    customers = of("customers").filter("id is not null").select(F.col("id").alias("customer_id"), "row_hash", "body")
    new = {"customers": incremental.upsert(state["customers"], customers, "customer_id")}
    cases = of("lawsuits").select(F.col("id").alias("case_id"), "row_hash", "body")
    pairs = of("lawsuits").select(F.col("id").alias("case_id"), F.explode("customers").alias("customer_id"), "page_offset")
    found = incremental.upsert_cases(state["cases"], state["bridge"], cases, pairs, new["customers"])
    new["cases"], changed, errors = found["cases"], [found["changed_cases"]], found["errors"].count()
    outside = state["bridge"].join(cases, "case_id", "left_anti")
    new["bridge"] = outside.unionByName(found["bridge"].filter("action <> 'delete'").drop("action"))
    entries = of("transactions").select(F.col("id").alias("entry_id"), "case_id", "row_hash", "body", "page_offset")
    found = incremental.upsert_transactions(state["transactions"], entries, new["cases"])
    new["transactions"], errors = found["transactions"], errors + found["errors"].count()
    changed.append(found["changed_cases"])
    movements = of("movements").select("case_id", "fingerprint", "body", "page_offset")
    found = incremental.append_movements(state["movements"], movements, new["cases"])
    new["movements"] = state["movements"].unionByName(found["new"].drop("page_offset"))
    changed.append(found["changed_cases"])
    errors += found["errors"].count()
    changed_cases = reduce(lambda a, b: a.unionByName(b), changed).distinct()
    touched = incremental.changed_keys(new["customers"], "customer_id")
    partners = link_ops.affected_partners(touched, changed_cases, new["bridge"], links, DAY)
    kept = {n: spark.createDataFrame(new[n].select(*state[n].columns).collect(), EMPTY[n]) for n in EMPTY}
    return kept, sorted(r["partner_id"] for r in partners.collect()), errors


@pytest.fixture(scope="module")
def links(spark):
    rows = [(i, i % 7, "customer" if i % 2 else "case", 1 + i % 26, None, None, "active") for i in range(60)]
    return spark.createDataFrame(rows, LINKS).withColumn("valid_from", F.lit("2020-01-01").cast("date"))


def test_three_runs_equal_the_batch_operators_and_repeat_without_a_trace(spark, rows, links, tmp_path):
    state = {n: spark.createDataFrame([], schema) for n, schema in EMPTY.items()}
    folder = str(tmp_path / "tables")
    names = {"customers": "customers", "cases": "cases", "bridge": "pairs_by_case", "transactions": "transactions", "movements": "movements"}
    for run in range(3):
        batch = records(run)
        frame = spark.createDataFrame(batch, sync.RECORD).repartition(3)
        if run == 1:
            # A run that breaks off before its ledger entry leaves no trace, whatever it had written.
            broken = spark.createDataFrame(records(77), sync.RECORD)
            with pytest.raises(Exception, match="partner_id"):
                sync.apply_run(broken, run, folder, links.drop("partner_id"), DAY, 3)
            assert not sync.SyncTables(spark, folder, run, 3).committed
        sync.apply_run(frame, run, folder, links, DAY, 3)
        if run == 2:
            sync.apply_run(frame, run, folder, links, DAY, 3)
        state, partners, errors = batch_run(spark, state, batch, links, run)
        tables = sync.SyncTables(spark, folder, run, 3)
        for name, log in names.items():
            columns = state[name].columns
            assert rows(tables[log].state(), *columns) == rows(state[name], *columns), (run, name)
        assert rows(tables["pairs_by_customer"].state()) == rows(tables["pairs_by_case"].state())
        assert sorted(r["partner_id"] for r in tables["partners"].changes(run).collect()) == partners
        assert tables["errors"].changes(run).count() == errors


def test_lookups_read_a_bounded_number_of_segments(spark, rows, tmp_path):
    """Nine batches over the same keys: folders and rows of a lookup don't grow with the log."""
    folder = str(tmp_path / "log")
    last = {}
    for batch in range(9):
        ledger = Ledger(spark, folder)
        assert ledger.load(batch - 1) == (batch > 0)
        log = KeyedLog(ledger, folder, "t", "id long, value string", "id", buckets=2)
        changed = [(i, f"{batch}", "delete" if (i + batch) % 5 == 0 else "update") for i in range(batch % 3, 12, 2)]
        log.log(spark.createDataFrame(changed, "id long, value string, action string"), batch)
        ledger.commit(batch)
        for i, value, action in changed:
            last.pop(i, None)
            if action != "delete":
                last[i] = value
        assert len(log.paths()) <= 2 * MOST_SEGMENTS
        assert rows(log.state()) == sorted(last.items(), key=repr)
        assert spark.read.parquet(*log.paths()).count() <= 12 * MOST_SEGMENTS
    found = log.state_of(spark.createDataFrame([(3,), (4,), (99,), (None,)], "k long"), "k")
    assert rows(found) == sorted([(k, v) for k, v in last.items() if k in (3, 4)], key=repr)


def test_a_run_without_records_is_committed(spark, links, tmp_path):
    folder = str(tmp_path / "tables")
    sync.apply_run(spark.createDataFrame([], sync.RECORD), 0, folder, links, DAY)
    tables = sync.SyncTables(spark, folder, 0)
    assert tables.committed and tables["customers"].state().collect() == []


def test_a_run_looks_its_references_up_once(spark, links, tmp_path):
    """What a run stores, its errors and its partners come from the same lookups: few stages, whatever the rows."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one run", "one run")
    try:
        sync.apply_run(spark.createDataFrame(records(5), sync.RECORD), 0, str(tmp_path / "tables"), links, DAY, 3)
        jobs = len(tracker.getJobIdsForGroup("one run"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 75


def test_a_table_of_one_segment_is_read_without_a_sort(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.load(-1)
    log = KeyedLog(ledger, str(tmp_path), "t", "id long", "id", buckets=2)
    log.log(spark.range(9).withColumn("action", F.lit("insert")), 0)
    assert "Window" not in log.newest()._jdf.queryExecution().optimizedPlan().toString()
    log.log(spark.range(4).withColumn("action", F.lit("delete")), 1)
    assert sorted(r["id"] for r in log.state().collect()) == [4, 5, 6, 7, 8]
