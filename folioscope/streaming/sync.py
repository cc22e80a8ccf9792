"""A sync run as one streaming job over customers, cases, transactions and movements.

Every micro-batch is a run: it applies the batch operators of ``operators.incremental`` to the rows of the
batch and the stored rows of the same keys, finds the partners whose portfolio changed, and commits all
tables together (see ``keyed_log``). A repeated batch repeats itself without a trace.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import incremental, links as link_ops
from folioscope.operators.spread import first_rows
from folioscope.streaming.keyed_log import BUCKETS, KeyedLog, Ledger, buckets_of

#: Records of all four collections: the id of a customer, case or transaction; the case of a transaction or
#: movement; the customers of a case; the fingerprint of a movement.
RECORD = (
    "resource string, id bigint, case_id bigint, fingerprint string, customers array<bigint>, "
    "row_hash string, page_offset bigint, body string"
)
RESOURCES = ("customers", "lawsuits", "transactions", "movements")
_SCHEMAS = {
    "customers": ("customer_id bigint, row_hash string, body string, status string", "customer_id", None),
    "cases": ("case_id bigint, row_hash string, body string, status string", "case_id", None),
    "pairs_by_case": ("case_id bigint, customer_id bigint", "case_id", ["case_id", "customer_id"]),
    "pairs_by_customer": ("case_id bigint, customer_id bigint", "customer_id", ["case_id", "customer_id"]),
    "transactions": ("entry_id bigint, case_id bigint, row_hash string, body string", "entry_id", None),
    "movements": ("case_id bigint, fingerprint string, body string", "case_id", ["case_id", "fingerprint"]),
    "errors": ("error_code string, reference bigint, page_offset bigint", "reference", ["error_code", "reference", "page_offset", "batch"]),
    "partners": ("run_id bigint, partner_id bigint", "partner_id", ["run_id", "partner_id"]),
}
_CHANGED = "action in ('insert', 'update')"


class SyncTables:
    """The tables of a sync as committed by a batch."""

    def __init__(self, spark: SparkSession, folder: str, batch: int | None = None, buckets: int = BUCKETS):
        self.ledger = Ledger(spark, folder)
        self.committed = batch is not None and self.ledger.load(batch)
        self.logs = {n: KeyedLog(self.ledger, folder, n, *spec, buckets, n == "errors") for n, spec in _SCHEMAS.items()}

    def __getitem__(self, name: str) -> KeyedLog:
        return self.logs[name]


def _staged(batch: DataFrame, folder: str, number: int) -> dict[str, DataFrame]:
    """The batch's records by collection, written once; of records with one key the one of the last page counts."""
    keyed = batch.filter(F.col("resource").isin(*RESOURCES[:3]) & F.col("id").isNotNull())
    newest = first_rows(keyed, ["resource", "id"], [F.col("page_offset").desc(), F.col("row_hash").desc()])
    movements = batch.filter((F.col("resource") == "movements") & F.col("case_id").isNotNull())
    rows = _kept(newest.unionByName(movements), f"{folder}/staging/batch={number}", "resource")
    return {r: rows.filter(F.col("resource") == r) for r in RESOURCES}


def apply_run(
    batch: DataFrame, number: int, folder: str, links: DataFrame, day: dt.date | str, buckets: int = BUCKETS
) -> None:
    """One run over the records of a micro-batch, on top of the run before it; all runs have the same ``buckets``."""
    t = SyncTables(batch.sparkSession, folder, number - 1, buckets)
    records = _staged(batch, folder, number)
    error = F.lit("error").alias("action")

    customers = records["customers"].select(F.col("id").alias("customer_id"), "row_hash", "body")
    cases = records["lawsuits"].select(F.col("id").alias("case_id"), "row_hash", "body")
    pairs = records["lawsuits"].select(F.col("id").alias("case_id"), F.explode("customers").alias("customer_id"), "page_offset")
    entries = records["transactions"].select(F.col("id").alias("entry_id"), "case_id", "row_hash", "body", "page_offset")
    movements = records["movements"].select("case_id", "fingerprint", "body", "page_offset")
    of_customers, of_cases, of_pairs, of_entries, of_entry_cases, of_movements = buckets_of(
        (customers, "customer_id"), (cases, "case_id"), (pairs, "customer_id"),
        (entries, "entry_id"), (entries, "case_id"), (movements, "case_id"), buckets=buckets,
    )

    state = incremental.upsert(t["customers"].state_of(customers, "customer_id", of_customers), customers, "customer_id")
    changed_customers = t["customers"].log(state.filter(_CHANGED), number).select("customer_id")

    state = incremental.upsert(t["cases"].state_of(cases, "case_id", of_cases), cases, "case_id")
    changed_cases = [t["cases"].log(state.filter(_CHANGED), number)]

    # Whether a reference is known decides both what is stored and what is an error, so it is looked up once.
    def marked(name: str, rows: DataFrame, known: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
        return _kept(incremental.mark_known(rows, known, key, row_id), f"{folder}/marked/batch={number}/{name}")

    named = pairs.filter("customer_id is not null")
    named = marked("pairs", named, t["customers"].state_of(named, "customer_id", of_pairs), "customer_id")
    errors = [incremental.lost_references(named, "customer_id", "missing_customer").withColumnRenamed("customer_id", "reference")]
    bridge = incremental.diff_pairs(t["pairs_by_case"].state_of(cases, "case_id", of_cases), named.filter("_known"), cases)
    changed_cases.append(t["pairs_by_case"].log(bridge.filter("action <> 'keep'"), number))
    t["pairs_by_customer"].log(changed_cases[-1].drop("batch"), number)

    entries = marked("transactions", entries, t["cases"].state_of(entries, "case_id", of_entry_cases), "case_id", "entry_id")
    found = incremental.upsert_marked(t["transactions"].state_of(entries, "entry_id", of_entries), entries)
    errors.append(found["errors"].withColumnRenamed("case_id", "reference"))
    # The old cases of changed rows are written beside their new ones, for the partners below.
    changed = t["transactions"].log(found["transactions"].filter(_CHANGED), number, "previous_case_id bigint")
    changed_cases.append(incremental.old_and_new_cases(changed))

    movements = marked("movements", movements, t["cases"].state_of(movements, "case_id", of_movements), "case_id")
    found = incremental.append_marked(t["movements"].state_of(movements, "case_id", of_movements), movements)
    errors.append(found["errors"].withColumnRenamed("case_id", "reference"))
    changed_cases.append(t["movements"].log(found["new"].withColumn("action", F.lit("insert")), number))
    lost = reduce(DataFrame.unionByName, errors).select("error_code", "reference", "page_offset", error)
    t["errors"].log(lost, number)

    changed_cases = reduce(DataFrame.unionByName, [rows.select("case_id") for rows in changed_cases]).distinct()
    changed_cases = _kept(changed_cases, f"{folder}/changed/batch={number}/lawsuits")
    of_customers, of_cases = buckets_of((changed_customers, "customer_id"), (changed_cases, "case_id"), buckets=buckets)
    partners = link_ops.partners_showing(
        changed_customers,
        changed_cases,
        t["pairs_by_customer"].state_of(changed_customers, "customer_id", of_customers),
        t["pairs_by_case"].state_of(changed_cases, "case_id", of_cases),
        links,
        day,
    )
    t["partners"].log(incremental.changed_partners(number, partners).withColumn("action", F.lit("insert")), number)
    t.ledger.commit(number)


def _kept(rows: DataFrame, path: str, *by: str) -> DataFrame:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_sync(
    stream: DataFrame, links: DataFrame, day: dt.date | str, folder: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Runs every micro-batch of ``RECORD`` rows as a sync into the tables under ``folder``.

    ``buckets`` is how many folders a table's keys are dealt to: as many as keep one bucket in a task's memory.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: apply_run(batch, number, folder, links, day, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
