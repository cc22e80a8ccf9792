"""Latest-per-key selections, pages and top-k lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.links import in_scope
from folioscope.operators.spread import first_rows
from folioscope.session import work_folder

READY = ("validated", "published")
ACTIVE = ("pending", "running")


def latest_movement(movements: DataFrame, cases: DataFrame, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Latest movement per known case, future ones ignored; the lowest id wins a tie.

    A max over a struct is a plain aggregate with map-side combine, so a busy case costs one row
    per task in the shuffle.
    """
    seen = movements if as_of is None else movements.filter(F.col("occurred_at") <= F.lit(str(as_of)).cast("timestamp"))
    best = F.max(F.struct("occurred_at", (-F.col("movement_id")).alias("_minus_id"), "title"))
    return (
        seen.groupBy("case_id")
        .agg(best.alias("_best"))
        .join(cases.select("case_id").distinct(), "case_id", "left_semi")
        .select(
            "case_id",
            F.col("_best.occurred_at").alias("last_movement_at"),
            F.col("_best.title").alias("last_movement_title"),
        )
    )


def latest_version(versions: DataFrame, statuses: Sequence[str] = READY) -> DataFrame:
    """Newest usable report version of each partner."""
    order = [F.col("generated_at").desc(), F.col("version").desc(), F.col("version_id").desc()]
    return first_rows(versions.filter(F.col("status").isin(*statuses)), ["partner_id"], order)


def latest_decision(reviews: DataFrame, decision: str | None = None) -> DataFrame:
    """Decision with the highest revision per item."""
    wanted = reviews if decision is None else reviews.filter(F.col("decision") == decision)
    return first_rows(wanted, ["item_id"], [F.col("review_revision").desc(), F.col("review_id").desc()])


def latest_request(requests: DataFrame, by: str = "partner_id", active_first: bool = False) -> DataFrame:
    """Newest request per partner or batch; an active one may win over finished ones."""
    order = [F.col("created_at").desc(), F.col("request_id").desc()]
    if active_first:
        order = [F.col("status").isin(*ACTIVE).desc(), *order]
    return first_rows(requests, [by], order)


def latest_run(runs: DataFrame) -> DataFrame:
    return first_rows(runs, ["batch_id"], [F.col("created_at").desc(), F.col("run_id").desc()])


def next_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``next_version`` = highest stored version + 1 for each new (partner, period)."""
    keys = ["partner_id", "period_start", "period_end"]
    top = versions.groupBy(*keys).agg(F.max("version").alias("_top"))
    return new.join(top, keys, "left").withColumn("next_version", F.coalesce("_top", F.lit(0)) + 1).drop("_top")


def last_change(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Finish time of the last successful run that changed each partner."""
    done = runs.filter("status = 'succeeded'").select("run_id", "finished_at")
    per_run = changes.select("run_id", "partner_id").distinct()
    return per_run.join(done, "run_id").groupBy("partner_id").agg(F.max("finished_at").alias("changed_at"))


def last_sync(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'succeeded'").agg(F.max("finished_at").alias("last_sync_at"))


def ready_reports(versions: DataFrame, partners: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest usable versions of active partners (a per-task top-k, then a merge)."""
    live = partners.filter("status = 'active' and deleted_at is null").select("partner_id", "name")
    return (
        versions.filter(F.col("status").isin(*READY))
        .join(live, "partner_id")
        .orderBy(F.col("generated_at").desc(), F.col("version_id").desc())
        .limit(n)
    )


def batch_filter(
    partner_id: int | None = None,
    state: str | None = None,
    period_start: dt.date | str | None = None,
    period_end: dt.date | str | None = None,
) -> Column:
    """Conditions of the batch list; the period filter keeps every overlapping batch."""
    condition = F.lit(True)
    if partner_id is not None:
        condition &= F.col("partner_id") == partner_id
    if state is not None:
        condition &= F.col("state") == state
    if period_start is not None:
        condition &= F.col("period_end") >= F.lit(str(period_start)).cast("date")
    if period_end is not None:
        condition &= F.col("period_start") <= F.lit(str(period_end)).cast("date")
    return condition


def page(df: DataFrame, condition: Column, order: Sequence[Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page of the filtered rows with the total number of rows."""
    kept = df.filter(condition)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total_rows", total)


def _listed(
    partners: DataFrame, versions: DataFrame, requests: DataFrame, changes: DataFrame, query: str = "", scope: str | None = None
) -> DataFrame:
    """Active partners with their derived status, in no order."""
    from folioscope.operators.status import partner_status

    live = partners.filter("status = 'active' and deleted_at is null")
    if scope:
        live = in_scope(live, scope)
    if query:
        needle = F.lower(F.lit(query))
        live = live.filter(F.lower("name").contains(needle) | F.lower("external_id").contains(needle))
    return partner_status(live, versions, requests, changes)


def catalog(
    partners: DataFrame,
    versions: DataFrame,
    requests: DataFrame,
    changes: DataFrame,
    query: str = "",
    status: str | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Active partners with their derived status, searched by name or code without case."""
    listed = _listed(partners, versions, requests, changes, query, scope)
    if status:
        listed = listed.filter(F.col("report_status") == status)
    return listed.orderBy("name", "external_id")


def catalog_page(listed: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page of the catalog with ``page``, ``pages`` and ``total_rows``.

    A number before the first or past the last page means that page; an empty catalog has one empty page.
    """
    total = listed.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    shown = listed.orderBy("name", "external_id").offset((number - 1) * size).limit(size)
    return shown.withColumns({"page": F.lit(number), "pages": F.lit(pages), "total_rows": F.lit(total)})


def catalog_pages(
    partners: DataFrame,
    versions: DataFrame,
    requests: DataFrame,
    changes: DataFrame,
    statuses: Sequence[str],
    number: int,
    size: int = 20,
    query: str = "",
    scope: str | None = None,
) -> DataFrame:
    """The page ``number`` of the catalog under each of the statuses.

    Statuses are derived once, for all pages: the list is written to the shared work folder.
    """
    listed = _listed(partners, versions, requests, changes, query, scope)
    folder = work_folder(listed.sparkSession, "catalog")
    listed.write.parquet(folder)
    written = listed.sparkSession.read.schema(listed.schema).parquet(folder)
    pages = [catalog_page(written.filter(F.col("report_status") == s), number, size) for s in statuses]
    return reduce(DataFrame.unionByName, pages)


def set_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).unionByName(right.select(*keys)).distinct()


def set_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def set_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def retryable(requests: DataFrame) -> DataFrame:
    """One failed request (the lowest id) per partner that has no active request."""
    active = requests.filter(F.col("status").isin(*ACTIVE)).select("partner_id").distinct()
    failed = requests.filter("status = 'failed'").join(active, "partner_id", "left_anti")
    return first_rows(failed, ["partner_id"], [F.col("request_id").asc()])


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in the given order, for all groups at once."""
    return first_rows(df, by, order, n)


def work_queue(
    batches: DataFrame, partners: DataFrame, runs: DataFrame, requests: DataFrame, versions: DataFrame, n: int = 30
) -> DataFrame:
    """The newest ``n`` open batches with a lane (attention, in_progress) and the step they are at."""
    newest = (
        batches.filter(~F.col("state").isin("rejected", "superseded", "failed"))
        .join(partners.select("partner_id", "name"), "partner_id")
        .orderBy(F.col("created_at").desc(), F.col("batch_id").desc())
        .limit(n)
    )
    keys = newest.select("batch_id")
    run = latest_run(runs.join(keys, "batch_id", "left_semi")).select(
        "batch_id", (F.col("result_total") - F.col("matched_count")).alias("_unmatched")
    )
    request = latest_request(requests.join(keys, "batch_id", "left_semi"), "batch_id", active_first=True).select(
        "batch_id", F.col("status").alias("_request")
    )
    done = versions.filter(F.col("status").isin(*READY)).join(keys, "batch_id", "left_semi").select(
        "batch_id", F.lit(True).alias("_done")
    ).distinct()
    open_items = F.coalesce("_unmatched", "parsed_item_count")
    check_failed = (F.col("processing_status") == "failed") & F.col("state").isin("quarantined", "parsed", "needs_review")
    checking = ~F.col("state").isin("needs_review", "approved") | F.col("processing_status").isin(*ACTIVE)
    step = (
        F.when(check_failed, "check_failed")
        .when(checking, "checking")
        .when((F.col("state") == "needs_review") & (open_items != 0), "corrections_open")
        .when(F.col("state") == "needs_review", "ready_to_approve")
        .when(F.col("_request").isin(*ACTIVE), "generating")
        .when(F.col("_request") == "failed", "generation_failed")
        .when(F.col("_done").isNull(), "report_not_generated")
    )
    lane = F.when(F.col("step").isin("checking", "generating"), "in_progress").otherwise("attention")
    return (
        newest.join(run, "batch_id", "left")
        .join(request, "batch_id", "left")
        .join(done, "batch_id", "left")
        .withColumn("step", step)
        .filter("step is not null")
        .withColumn("lane", lane)
        .withColumn("open_items", F.when(F.col("step") == "corrections_open", open_items))
        .select("batch_id", "partner_id", "name", "created_at", "lane", "step", "open_items")
    )
