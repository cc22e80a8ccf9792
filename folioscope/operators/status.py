"""Derived statuses, gates and audits of imports, reports and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import local_day
from folioscope.operators.latest import ACTIVE, READY, latest_decision, latest_request, latest_run, latest_version
from folioscope.operators.reconcile import HARMLESS_FLAG
from folioscope.operators.spread import first_rows, repeated_keys

# Allowed state changes of an import.
TRANSITIONS = {
    "uploaded": ("quarantined",),
    "quarantined": ("parsing", "rejected", "failed"),
    "parsing": ("parsed", "needs_review", "rejected", "failed"),
    "parsed": ("reconciling", "needs_review"),
    "reconciling": ("approved", "needs_review", "failed"),
    "needs_review": ("reconciling", "approved", "rejected", "superseded"),
    "failed": ("quarantined",),
    "approved": ("superseded",),
    "rejected": (),
    "superseded": (),
}

# Audit events that may be written.
AUDIT_ACTIONS = (
    "login_succeeded",
    "login_failed",
    "login_limited",
    "logout",
    "catalog_view",
    "partner_view",
    "report_view",
    "report_download",
    "artifact_denied",
    "generation_requested",
    "report_version_restored",
    "account_created",
    "account_disabled",
    "sessions_revoked",
    "security_metadata_purged",
    "link_changed",
    "pdf_upload_succeeded",
    "pdf_upload_rejected",
    "pdf_upload_duplicate",
    "pdf_upload_failed",
    "pdf_review_approved",
    "pdf_review_rejected",
    "pdf_review_corrected",
    "pdf_review_reprocess_requested",
    "pdf_review_superseded",
    "partner_created",
    "partner_pilot_enabled",
    "partner_pilot_disabled",
    "partner_percentage_changed",
    "password_changed",
    "password_change_failed",
    "password_reset",
    "account_enabled",
    "account_role_changed",
    "access_link_issued",
    "access_link_redeemed",
)
AUDIT_ENTITIES = ("none", "user", "partner", "report_version", "pdf_import_batch")
AUDIT_REASONS = (
    "invalid_credentials",
    "rate_limited",
    "access_denied",
    "FILE_EMPTY",
    "FILE_NOT_PDF",
    "PDF_MALFORMED",
    "PDF_ENCRYPTED",
    "SIZE_LIMIT_EXCEEDED",
    "PAGE_LIMIT_EXCEEDED",
    "PAGE_FORMAT_UNSUPPORTED",
    "PDF_ANNOTATED_SOURCE",
    "SOURCE_SCOPE_INVALID",
    "DUPLICATE_SOURCE",
    "STORAGE_UNAVAILABLE",
)


def partner_status(partners: DataFrame, versions: DataFrame, requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``report_status``; ``changes`` holds the last change per partner (see last_change).

    A request that is not newer than the report says nothing any more.
    """
    version = latest_version(versions).select(
        "partner_id", "version_id", "generated_at", F.col("status").alias("_version")
    )
    request = latest_request(requests).select(
        "partner_id", F.col("status").alias("_request"), F.col("created_at").alias("_asked_at")
    )
    asked = F.when(
        F.col("generated_at").isNull() | (F.col("_asked_at") > F.col("generated_at")), F.col("_request")
    )
    status = (
        F.when(asked.isin(*ACTIVE), "gerando")
        .when(asked == "failed", "erro")
        .when(F.col("_version").isNull(), "sem relatório")
        .when(F.col("changed_at") > F.col("generated_at"), "desatualizado")
        .otherwise("atualizado")
    )
    return (
        partners.join(version, "partner_id", "left")
        .join(request, "partner_id", "left")
        .join(changes, "partner_id", "left")
        .withColumn("report_status", status)
        .drop("_version", "_request", "_asked_at")
    )


def _last_asked(reviews: DataFrame) -> DataFrame:
    """Per batch the run whose reprocessing was asked for last, and when."""
    order = [F.col("review_revision").desc(), F.col("review_id").desc()]
    return first_rows(reviews.filter("decision = 'reprocess_requested'"), ["batch_id"], order).select(
        "batch_id", F.col("run_id").alias("_asked_run"), F.col("created_at").alias("_asked_at")
    )


def _pending(run: Column) -> Column:
    """Whether reprocessing was asked for on a run and isn't finished since."""
    finished = (F.col("processing_status") == "succeeded") & (F.col("processing_finished_at") > F.col("_asked_at"))
    return F.coalesce((F.col("_asked_run") == run) & ~F.coalesce(finished, F.lit(False)), F.lit(False))


def reprocess_pending(batches: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reprocess_pending`` per batch with a run: asked for on that run and not finished since."""
    return (
        batches.select("batch_id", "processing_status", "processing_finished_at")
        .join(latest_run(runs).select("batch_id", "run_id"), "batch_id")
        .join(_last_asked(reviews), "batch_id", "left")
        .select("batch_id", "run_id", _pending(F.col("run_id")).alias("reprocess_pending"))
    )


def approval_blocked(
    batches: DataFrame,
    runs: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    four_eyes_actor: int | None = None,
) -> DataFrame:
    """``open_issues`` and ``approval_blocked`` per batch.

    Blocks without a run or items, on a pending reprocess, on a manifest that is incomplete or
    carries a flag, on unresolved items, and on several approved batches of the same period.
    """
    current = latest_run(runs).select("batch_id", F.col("run_id").alias("_run"))
    corrected = latest_decision(reviews, "corrected").select("item_id", F.lit(True).alias("_corrected"))
    flagged = F.exists("quality_flags", lambda f: f != HARMLESS_FLAG)
    # Items are counted where their batch is; only those that a correction may settle go by their id.
    manifest = (
        items.join(current, "batch_id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count_if(flagged).alias("_flagged"),
            F.count_if(F.col("run_id") == F.col("_run")).alias("_items"),
        )
    )
    follows = F.col("status").isin("unmatched", "ambiguous")
    unmatched = (
        items.filter("status <> 'matched'")
        .join(current, "batch_id")
        # Not an equality, which would be one more key and send the items by batch and run.
        .filter(F.col("run_id").between(F.col("_run"), F.col("_run")))
        .select("batch_id", "item_id", follows.alias("_follows"))
        .join(corrected, "item_id", "left")
        .groupBy("batch_id")
        .agg(
            F.count_if(~F.col("_follows") | F.col("_corrected").isNull()).alias("_unsolved"),
            F.count_if(F.col("_corrected").isNull()).alias("open_issues"),
        )
    )
    period = ["partner_id", "period_start", "period_end"]
    approved = batches.filter("state = 'approved'").groupBy(*period).agg(F.count(F.lit(1)).alias("_approved"))
    zero = F.lit(0).cast("bigint")
    wide = (
        batches.join(manifest, "batch_id", "left")
        .join(unmatched, "batch_id", "left")
        .join(current, "batch_id", "left")
        .join(_last_asked(reviews), "batch_id", "left")
        .join(approved, period, "left")
        .withColumns(
            {c: F.coalesce(c, zero) for c in ("_items", "_unsolved", "open_issues", "_rows", "_flagged", "_approved")}
        )
    )
    others = F.col("_approved") - F.when(F.col("state") == "approved", 1).otherwise(0)
    blocked = (
        (F.col("_items") == 0)
        | F.col("_run").isNull()
        | _pending(F.col("_run"))
        | (others > 1)
        | (F.col("_rows") != F.col("parsed_item_count"))
        | (F.col("_flagged") > 0)
        | (F.col("_unsolved") > 0)
    )
    if four_eyes_actor is not None:
        blocked |= F.col("uploaded_by") == four_eyes_actor
    return wide.withColumn("approval_blocked", blocked).select(
        *batches.columns, "open_issues", "approval_blocked"
    )


def batch_stage(batches: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``stage``: the step of the upload-to-report flow a batch is in.

    ``batches`` comes from :func:`approval_blocked`.
    """
    newest = [F.col("generated_at").desc(), F.col("version_id").desc()]
    version = first_rows(versions, ["batch_id"], newest).select("batch_id", F.col("status").alias("_version"))
    request = latest_request(requests, "batch_id", active_first=True).select(
        "batch_id", F.col("status").alias("_request")
    )
    state, request_active = F.col("state"), F.coalesce(F.col("_request").isin(*ACTIVE), F.lit(False))
    failed = (state == "failed") | (
        state.isin("quarantined", "parsed", "needs_review") & (F.col("processing_status") == "failed")
    )
    review = (
        F.when(F.col("processing_status").isin(*ACTIVE), "processing")
        .when(F.col("open_issues") > 0, "issues")
        .when(F.col("approval_blocked"), "blocked")
        .otherwise("ready")
    )
    stage = (
        F.when(state.isin("rejected", "superseded"), state)
        .when((state == "approved") & request_active, "generating")
        .when(F.col("_version").isin(*READY), "done")
        .when(failed, "failed")
        .when(state == "needs_review", review)
        .when((state == "approved") & (F.col("_request") == "failed"), "generation_failed")
        .when(state == "approved", "approved")
        .otherwise("processing")
    )
    return (
        batches.join(version, "batch_id", "left")
        .join(request, "batch_id", "left")
        .withColumn("stage", stage)
        .drop("_version", "_request")
    )


#: Events of one import that may meet in one window.
EVENT_SLICE = 4096


def invalid_transitions(events: DataFrame) -> DataFrame:
    """State changes that are not allowed or do not continue the previous one.

    An import starts with ``uploaded`` from no state; every other event has a state to come from. The
    predecessor is the event with the next smaller number, whatever numbers are missing: it is looked
    up inside a slice of numbers, then in the slice before, so a very long log is not one window.
    """
    pairs = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    sliced = events.withColumn("_slice", F.floor(F.col("seq") / EVENT_SLICE))
    ends = sliced.groupBy("batch_id", "_slice").agg(F.max(F.struct("seq", "to_state")).alias("_end"))
    earlier = F.lag("_end").over(Window.partitionBy("batch_id").orderBy("_slice"))
    ends = ends.withColumn("_before", earlier).drop("_end")
    here = Window.partitionBy("batch_id", "_slice").orderBy("seq")
    joined = sliced.withColumn("_here", F.lag(F.struct("seq", "to_state")).over(here)).join(ends, ["batch_id", "_slice"])
    before = F.coalesce("_here", "_before")
    starts = before.isNull() & F.col("from_state").isNull() & (F.col("to_state") == "uploaded")
    allowed = F.coalesce(F.concat(F.col("from_state"), F.lit(">"), F.col("to_state")).isin(*pairs), F.lit(False))
    violation = F.when(~starts & ~allowed, "not_allowed").when(
        ~starts & ~before["to_state"].eqNullSafe(F.col("from_state")), "chain_broken"
    )
    return joined.withColumn("violation", violation).filter("violation is not null").drop("_slice", "_here", "_before")


def constraint_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): all row rules are counted in one pass; a null result is no violation."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def unique_violations(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(rule, violations): rows beyond the first of each key."""
    extra = repeated_keys(df, keys).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("violations"))
    return extra.select(F.lit(rule).alias("rule"), F.col("violations").cast("bigint"))


def reference_violations(df: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, violations): rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    lost = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(known, key, "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")).select(
        F.lit(rule).alias("rule"), F.col("violations").cast("bigint")
    )


def amount_matches_status() -> Column:
    return (F.col("amount_status") == "available") == F.col("amount").isNotNull()


def unlisted_audit(events: DataFrame) -> DataFrame:
    """Audit events with an action, entity or reason outside the allow-list; only a reason may be missing."""
    listed = (
        F.col("action").isin(*AUDIT_ACTIONS)
        & F.col("entity_type").isin(*AUDIT_ENTITIES)
        & (F.col("reason_code").isNull() | F.col("reason_code").isin(*AUDIT_REASONS))
    )
    return events.filter(~F.coalesce(listed, F.lit(False)))


def report_gate(
    batches: DataFrame, runs: DataFrame, items: DataFrame, links: DataFrame, partners: DataFrame, targets: DataFrame
) -> DataFrame:
    """First reason that keeps a batch from being reported, null when it may be reported.

    The batch is approved and its partner live; its run and review are complete; every active link is
    still valid when the period ends and leads to an active case. ``links`` has valid_to (null: open).
    """
    run = latest_run(runs).select(
        "batch_id",
        "run_id",
        F.col("parser_version").alias("_parser"),
        "result_total",
        "snapshot_total",
        "snapshot_verified_at",
    )
    flagged = F.exists("quality_flags", lambda f: f != HARMLESS_FLAG)
    manifest = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(flagged).alias("_flagged"))
    in_run = items.groupBy("batch_id", "run_id").agg(F.count(F.lit(1)).alias("_items"))
    live = links.filter("status = 'active'")
    link_counts = live.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_links"))
    covered = (
        items.select("batch_id", "run_id", "item_id")
        .join(live.select("item_id").distinct(), "item_id", "left_anti")
        .groupBy("batch_id", "run_id")
        .agg(F.count(F.lit(1)).alias("_uncovered"))
    )
    usable = partners.filter("status = 'active' and deleted_at is null").select("partner_id", F.lit(True).alias("_usable"))
    open_cases = targets.filter("status = 'active'").select(F.col("case_id").alias("entity_id"), F.lit(True).alias("_open"))
    ended = F.col("valid_to") < F.col("period_end")
    broken = (
        live.join(batches.select("batch_id", "period_end"), "batch_id")
        .join(open_cases, "entity_id", "left")
        .groupBy("batch_id")
        .agg(F.count_if(ended).alias("_ended"), F.count_if(F.col("_open").isNull()).alias("_closed"))
    )
    zero = F.lit(0).cast("bigint")
    counts = ("_rows", "_flagged", "_items", "_links", "_uncovered", "_ended", "_closed")
    run_broken = (
        F.col("run_id").isNull()
        | (F.col("_parser") != F.col("parser_version"))
        | (F.col("result_total") != F.col("parsed_item_count"))
        | (F.col("snapshot_total") < F.col("result_total"))
        | (local_day(F.col("snapshot_verified_at")) < F.col("period_end"))
    )
    incomplete = (
        (F.col("_rows") != F.col("result_total"))
        | (F.col("_items") != F.col("result_total"))
        | (F.col("_links") != F.col("result_total"))
        | (F.col("_flagged") > 0)
        | (F.col("_uncovered") > 0)
    )
    reason = (
        F.when(F.col("state") != "approved", "batch_not_approved")
        .when(F.col("_usable").isNull(), "partner_not_live")
        .when(run_broken, "snapshot_incomplete")
        .when(incomplete, "review_incomplete")
        .when(F.col("_ended") > 0, "link_ended")
        .when(F.col("_closed") > 0, "case_inactive")
    )
    return (
        batches.join(run, "batch_id", "left")
        .join(manifest, "batch_id", "left")
        .join(in_run, ["batch_id", "run_id"], "left")
        .join(link_counts, "batch_id", "left")
        .join(covered, ["batch_id", "run_id"], "left")
        .join(broken, "batch_id", "left")
        .join(usable, "partner_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in counts})
        .select("batch_id", reason.alias("gate_reason"))
    )


def artifact_mismatches(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Versions whose stored digest is not the SHA-256 of html followed by pdf, or whose file is lost."""
    actual = F.sha2(F.concat("html", "pdf"), 256)
    reason = F.when(F.col("html").isNull() | F.col("pdf").isNull(), "missing").when(
        F.col("content_sha256").isNull() | (actual != F.col("content_sha256")), "digest"
    )
    return (
        versions.join(files, "storage_key", "left")
        .withColumn("reason", reason)
        .filter("reason is not null")
        .drop("html", "pdf")
    )


def four_eyes_violations(reviews: DataFrame, batches: DataFrame) -> DataFrame:
    """Decisions taken by the uploader, or on a revision that an earlier decision had already used."""
    used = reviews.groupBy("batch_id", "review_revision").agg(
        F.min(F.struct("created_at", "review_id")).getField("review_id").alias("_first")
    )
    joined = reviews.join(batches.select("batch_id", "uploaded_by"), "batch_id").join(
        used, ["batch_id", "review_revision"]
    )
    violation = F.when(F.col("reviewer") == F.col("uploaded_by"), "same_person").when(
        F.col("review_id") != F.col("_first"), "stale_revision"
    )
    return joined.withColumn("violation", violation).filter("violation is not null").drop("_first", "uploaded_by")
