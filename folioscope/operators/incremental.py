"""Incremental loading: digests decide what changed, changes decide which partners are affected.

Targets are never overwritten in place: every function returns the next state and the actions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.latest import ACTIVE, READY, latest_version
from folioscope.operators.links import in_scope
from folioscope.operators.spread import first_rows, join_null_safe, multiset_digest


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    hash_col: str = "row_hash",
    also_changed: Sequence[str] = (),
    status_col: str | None = "status",
) -> DataFrame:
    """Next state of ``target`` with ``action``: insert, update, keep or absent (not in the source).

    A row is updated when its digest or one of ``also_changed`` differs, or when it was inactive.
    Source columns win for inserted and updated rows; both sides have one row per key.
    """
    old = target.select(*[F.col(c).alias(f"_old_{c}") for c in target.columns])
    joined = old.join(source, F.col(f"_old_{key}") == F.col(key), "full_outer")
    differs = ~F.col(hash_col).eqNullSafe(F.col(f"_old_{hash_col}"))
    for column in also_changed:
        differs |= ~F.col(column).eqNullSafe(F.col(f"_old_{column}"))
    if status_col and status_col in target.columns:
        differs |= F.col(f"_old_{status_col}") != "active"
    action = (
        F.when(F.col(key).isNull(), "absent")
        .when(F.col(f"_old_{key}").isNull(), "insert")
        .when(differs, "update")
        .otherwise("keep")
    )
    written = F.col("action").isin("insert", "update")

    def value(column: str) -> Column:
        if column == status_col and column not in source.columns:
            new = F.lit("active")
        else:
            new = F.col(column)
        return F.when(written, new).otherwise(F.col(f"_old_{column}")).alias(column)

    previous = [F.col(f"_old_{c}").alias(f"previous_{c}") for c in also_changed]
    return joined.withColumn("action", action).select(*[value(c) for c in target.columns], *previous, "action")


def changed_keys(state: DataFrame, key: str) -> DataFrame:
    return state.filter(F.col("action").isin("insert", "update")).select(key)


def missing_references(source: DataFrame, known: DataFrame, key: str, code: str, offset_col: str = "page_offset") -> DataFrame:
    """One retryable error row per source row whose non-null reference is unknown."""
    known = known.select(key).distinct().withColumn("_known", F.lit(True))
    # Joined, not anti-joined: Spark would move an anti-join under a source that is dealt to more tasks.
    lost = source.filter(F.col(key).isNotNull()).join(known, key, "left").filter("_known is null")
    return lost.select(F.lit(code).alias("error_code"), F.lit(True).alias("retryable"), F.col(offset_col).alias("page_offset"), key)


def mark_known(source: DataFrame, known: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
    """``source`` with ``_known``: true where ``known``, which has each key once, has its ``key``, else null.

    Rows without a key are spread by ``row_id``.
    """
    marked = known.select(F.col(key).alias("_key"), F.lit(True).alias("_known"))
    same = F.col(key) == F.col("_key")
    if row_id is not None:
        # A number for each row without a key, so that they don't meet in one task.
        slot = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("r"), F.col(row_id).cast("string"))))
        same &= slot == F.xxhash64(F.col("_key").cast("string"))
    return source.join(marked, same, "left").drop("_key")


def lost_references(marked: DataFrame, key: str, code: str, offset_col: str = "page_offset") -> DataFrame:
    """The rows of ``missing_references`` for a source that ``mark_known`` has marked."""
    lost = marked.filter(F.col(key).isNotNull() & F.col("_known").isNull())
    return lost.select(F.lit(code).alias("error_code"), F.lit(True).alias("retryable"), F.col(offset_col).alias("page_offset"), key)


def diff_bridge(bridge: DataFrame, source_pairs: DataFrame, cases_in_batch: DataFrame, customers: DataFrame) -> DataFrame:
    """(case_id, customer_id, action) with delete, add or keep for the cases of a batch.

    Pairs of unknown customers are not added; cases outside the batch are not touched.
    """
    pair = ["case_id", "customer_id"]
    wanted = source_pairs.select(*pair).distinct().join(customers.select("customer_id"), "customer_id", "left_semi")
    return diff_pairs(bridge, wanted, cases_in_batch)


def diff_pairs(bridge: DataFrame, wanted: DataFrame, cases_in_batch: DataFrame) -> DataFrame:
    """``diff_bridge`` for pairs of known customers; equal pairs count once."""
    pair = ["case_id", "customer_id"]
    stored = bridge.select(*pair).join(cases_in_batch.select("case_id").distinct(), "case_id", "left_semi")
    sides = stored.withColumn("_stored", F.lit(1)).withColumn("_wanted", F.lit(0)).unionByName(
        wanted.select(*pair).withColumn("_stored", F.lit(0)).withColumn("_wanted", F.lit(1))
    )
    action = F.when(F.col("_wanted") == 0, "delete").when(F.col("_stored") == 0, "add").otherwise("keep")
    return (
        sides.groupBy(*pair)
        .agg(F.max("_stored").alias("_stored"), F.max("_wanted").alias("_wanted"))
        .select(*pair, action.alias("action"))
    )


def upsert_cases(target: DataFrame, bridge: DataFrame, source: DataFrame, source_pairs: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Case state, bridge actions, missing customers and the cases whose report may change."""
    state = upsert(target, source, "case_id")
    pairs = diff_bridge(bridge, source_pairs, source, customers)
    moved = pairs.filter("action <> 'keep'").select("case_id")
    return {
        "cases": state,
        "bridge": pairs,
        "errors": missing_references(source_pairs, customers, "customer_id", "missing_customer"),
        "changed_cases": changed_keys(state, "case_id").unionByName(moved).distinct(),
    }


def upsert_transactions(target: DataFrame, source: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """Transaction state, missing cases, and the old and new cases of every changed row.

    A reference to an unknown case is stored as null and reported.
    """
    return upsert_marked(target, mark_known(source, cases, "case_id", "entry_id"))


def upsert_marked(target: DataFrame, marked: DataFrame) -> dict[str, DataFrame]:
    """``upsert_transactions`` for a source that ``mark_known`` has marked."""
    resolved = marked.withColumn("case_id", F.when(F.col("_known"), F.col("case_id"))).drop("_known")
    state = upsert(target, resolved, "entry_id", also_changed=["case_id"], status_col=None)
    changed = state.filter(F.col("action").isin("insert", "update"))
    return {
        "transactions": state,
        "errors": lost_references(marked, "case_id", "missing_lawsuit"),
        "changed_cases": old_and_new_cases(changed),
    }


def old_and_new_cases(changed: DataFrame) -> DataFrame:
    """The cases that changed transactions name or named."""
    touched = changed.select(F.explode(F.array("case_id", "previous_case_id")).alias("case_id"))
    return touched.filter("case_id is not null").distinct()


def append_movements(target: DataFrame, source: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    """New movements by (case, fingerprint), missing cases and changed cases."""
    return append_marked(target, mark_known(source.filter("case_id is not null"), cases, "case_id"))


def append_marked(target: DataFrame, marked: DataFrame) -> dict[str, DataFrame]:
    """``append_movements`` for a source that ``mark_known`` has marked."""
    keys = ["case_id", "fingerprint"]
    known = marked.filter("_known").drop("_known")
    fresh = known.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return {
        "new": fresh,
        "errors": lost_references(marked, "case_id", "missing_lawsuit"),
        "changed_cases": fresh.select("case_id").distinct(),
    }


def changed_partners(run_id: str | int, *affected: DataFrame) -> DataFrame:
    """Distinct partners of a run."""
    union = reduce(DataFrame.unionByName, [a.select("partner_id") for a in affected])
    return union.distinct().select(F.lit(run_id).alias("run_id"), "partner_id")


def run_summary(actions: DataFrame, errors: DataFrame, partners: DataFrame, expected_total: int, next_offset: int) -> DataFrame:
    """One row about a run; it succeeded only after a full scan without unresolved errors."""
    unresolved = errors.agg(F.count_if(F.col("resolved_at").isNull()).alias("n")).scalar()
    counts = actions.filter("action <> 'absent'").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("action") == "insert").alias("inserted"),
        F.count_if(F.col("action") == "update").alias("updated"),
    )
    full = F.lit(next_offset >= expected_total)
    return (
        counts.withColumn("errors", unresolved)
        .withColumn("changed_partners", partners.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("status", F.when(full & (F.col("errors") == 0), "succeeded").otherwise("partial"))
    )


def reprocess_from(errors: DataFrame) -> DataFrame:
    """Lowest unresolved page offset per run and resource."""
    return errors.filter("resolved_at is null").groupBy("run_id", "resource").agg(F.min("page_offset").alias("page_offset"))


def resolve_errors(errors: DataFrame, page_offset: int, now: dt.datetime | str) -> DataFrame:
    """Marks the open errors of a page that has now been read successfully."""
    solved = F.col("resolved_at").isNull() & (F.col("page_offset") == page_offset)
    return errors.withColumn(
        "resolved_at", F.when(solved, F.lit(str(now)).cast("timestamp")).otherwise(F.col("resolved_at"))
    )


def change_cycle(
    sources: DataFrame,
    partners: DataFrame,
    versions: DataFrame,
    batches: DataFrame,
    requests: DataFrame,
    scope: str | None = None,
) -> DataFrame:
    """``outcome`` per scanned partner: unchanged, queued or already_active.

    Scanned are active partners that are not deleted and belong to the scope, if one is given. Partners
    with an approved batch follow their batch and are not scanned.
    """
    live = partners.filter("status = 'active' and deleted_at is null")
    if scope:
        live = in_scope(live, scope)
    sources = sources.join(live.select("partner_id"), "partner_id", "left_semi")
    approved = batches.filter("state = 'approved'").select("partner_id").distinct()
    last = latest_version(versions).select("partner_id", F.col("source_digest").alias("_seen"))
    busy = requests.filter(F.col("status").isin(*ACTIVE)).select("partner_id", F.lit(True).alias("_busy")).distinct()
    outcome = (
        F.when(F.col("source_digest").eqNullSafe(F.col("_seen")), "unchanged")
        .when(F.col("_busy"), "already_active")
        .otherwise("queued")
    )
    return (
        sources.join(approved, "partner_id", "left_anti")
        .join(last, "partner_id", "left")
        .join(busy, "partner_id", "left")
        .withColumn("outcome", outcome)
        .select("partner_id", "source_digest", "outcome")
    )


def cycle_counts(cycle: DataFrame) -> DataFrame:
    return cycle.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("outcome") != "unchanged").alias("changed"),
        F.count_if(F.col("outcome") == "queued").alias("queued"),
    )


def revision_key(content: DataFrame, meta: DataFrame, by: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Digest per row of ``meta`` over it and the report rows of its ``by`` key.

    ``columns`` are all that a report shows of a row; ``meta`` has every other input, such as period,
    source digest, parser and snapshot, in one row per report, named by ``keep``.
    """
    body = multiset_digest(content, columns, [by], "content_sha256").drop("rows")
    named = sorted([*meta.columns, "content_sha256"])
    joined = meta.join(body, by, "left")
    digest = F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)
    return joined.select(by, *keep, digest.alias("revision_key"))


def count_regressions(new: DataFrame, versions: DataFrame) -> DataFrame:
    """New counts that fall below those of the latest usable version."""
    last = latest_version(versions, READY).select(
        "partner_id", F.col("customer_count").alias("previous_customers"), F.col("case_count").alias("previous_cases")
    )
    fewer = (F.col("customer_count") < F.col("previous_customers")) | (F.col("case_count") < F.col("previous_cases"))
    return new.join(last, "partner_id").filter(fewer)


def replace_in_scope(
    target: DataFrame,
    source: DataFrame,
    scope: DataFrame,
    scope_key: str,
    key: Sequence[str],
    latest: Sequence[Column] | None = None,
) -> dict[str, DataFrame]:
    """Inside the scope the source replaces the target; the rest of the target stays.

    With ``latest``, an order, only the first source row of each scope key survives, as for the last
    movement of a case. ``foreign`` holds source rows outside the scope and must stay empty.
    """
    ids = scope.select(scope_key).distinct()
    outside = target.join(ids, scope_key, "left_anti")
    inside = source.join(ids, scope_key, "left_semi")
    if latest:
        inside = first_rows(inside, [scope_key], latest)
    stored = target.join(ids, scope_key, "left_semi").select(*key)
    return {
        "state": outside.unionByName(inside, allowMissingColumns=True),
        "deleted": join_null_safe(stored, inside.select(*key), key, "left_anti"),
        "foreign": source.join(ids, scope_key, "left_anti"),
    }


def updated_after(cutoff: dt.datetime | str, **frames: DataFrame) -> DataFrame:
    """(source, rows): normalised rows that changed after the run's cut-off, per input."""
    at = F.lit(str(cutoff)).cast("timestamp")
    counts = [
        frame.filter(F.col("updated_at") > at).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts).filter("rows > 0")


def stale_inputs(runs: DataFrame, **frames: DataFrame) -> DataFrame:
    """(run_id, source, last_change): inputs of a run's partner that changed after its snapshot was taken.

    ``runs`` has run_id, partner_id and snapshot_verified_at; each frame has partner_id and updated_at.
    A frame is reduced to its last change per partner before it meets the runs.
    """
    last = reduce(
        DataFrame.unionByName,
        [
            frame.groupBy("partner_id").agg(F.max("updated_at").alias("last_change")).withColumn("source", F.lit(name))
            for name, frame in frames.items()
        ],
    )
    return (
        runs.select("run_id", "partner_id", "snapshot_verified_at")
        .join(last, "partner_id")
        .filter(F.col("last_change") > F.col("snapshot_verified_at"))
        .select("run_id", "source", "last_change")
    )


def restore_version(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """Statuses after restoring one version per partner (``targets``: version_id).

    Usable versions newer than the restored one become superseded.
    """
    restorable = versions.filter(
        F.col("status").isin(*READY, "superseded") & F.col("storage_key").isNotNull()
    ).join(targets.select("version_id"), "version_id", "left_semi")
    cut = restorable.groupBy("partner_id").agg(
        F.max(F.struct("generated_at", "version_id")).alias("_cut")
    )
    restored = F.col("version_id") == F.col("_cut.version_id")
    newer = F.col("status").isin(*READY) & (F.col("generated_at") > F.col("_cut.generated_at"))
    return (
        versions.join(cut, "partner_id", "left")
        .withColumn("status", F.when(restored, "validated").when(newer, "superseded").otherwise(F.col("status")))
        .drop("_cut")
    )
