"""Exact-key reconciliation of manifests against a verified snapshot, and its follow-up steps.

Every manifest item gets exactly one outcome. Candidates are aggregated per key before the join,
so a key shared by very many candidates still adds one row, and no pairs are ever listed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import case_number, codes, folder_key, local_day
from folioscope.operators.latest import ACTIVE, latest_decision, latest_run
from folioscope.operators.spread import group_sizes, multiset_digest, own_key, repeated_keys

# Outcomes, unusable flags, the flag that never blocks, and the snapshot's life time.
STATUSES = ("matched", "unmatched", "ambiguous", "duplicate_source", "invalid_identifier")
UNUSABLE_FLAGS = ("invalid_identifier", "missing_identifier", "incomplete_block")
HARMLESS_FLAG = "page_continuation"
SNAPSHOT_MAX_AGE_MINUTES = 30
ACCEPTED_PENDING = "INVALID_IDENTIFIER_ACCEPTED_PENDING"


def with_keys(df: DataFrame) -> DataFrame:
    """Adds the normalised ``number`` and ``folder``."""
    return df.withColumn("number", case_number(F.col("process_number"))).withColumn("folder_norm", folder_key(F.col("folder")))


def _blocking(flags: Column) -> Column:
    return F.exists(flags, lambda f: f != HARMLESS_FLAG)


def candidate_index(candidates: DataFrame) -> DataFrame:
    """One row per (kind, key): number of candidates, and the id and folder of the only one."""
    entries = with_keys(candidates).select(
        F.col("external_id").alias("_target"),
        F.col("folder_norm").alias("_target_folder"),
        F.explode(
            F.array(
                F.struct(F.lit("number").alias("kind"), F.col("number").alias("key")),
                F.struct(F.lit("folder").alias("kind"), F.col("folder_norm").alias("key")),
            )
        ).alias("_entry"),
    )
    return (
        entries.filter("_entry.key is not null")
        .groupBy(F.col("_entry.kind").alias("_kind"), F.col("_entry.key").alias("_key"))
        .agg(
            F.count(F.lit(1)).alias("_candidates"),
            F.min("_target").alias("_target"),
            F.min("_target_folder").alias("_target_folder"),
        )
    )


def reconcile(manifest: DataFrame, candidates: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Status, method, matched_id and reason per item; repeats are looked for inside ``scope``.

    A given case number forbids the fallback to the folder.
    """
    has_number = F.col("process_number").isNotNull() & (F.col("process_number") != "")
    keyed = (
        with_keys(manifest)
        .withColumn("_kind", F.when(has_number, F.lit("number")).otherwise(F.lit("folder")))
        .withColumn("_value", F.when(has_number, F.col("number")).otherwise(F.col("folder_norm")))
        .withColumn("_key", own_key(F.col("_value"), F.col("item_id")))
    )
    copies = (
        group_sizes(keyed, [*scope, "_kind", "_value"], "_copies")
        .filter("_copies > 1")
        .withColumn("_key", own_key(F.col("_value"), F.lit("")))
        .drop("_value")
    )
    index = candidate_index(candidates).withColumn("_key", own_key(F.col("_key"), F.lit("")))
    joined = keyed.join(copies, [*scope, "_kind", "_key"], "left").join(index, ["_kind", "_key"], "left")

    flags = F.col("quality_flags")
    no_key = F.col("_value").isNull()
    conflict = (
        F.col("number").isNotNull()
        & F.col("folder_norm").isNotNull()
        & F.col("_target_folder").isNotNull()
        & (F.col("_target_folder") != F.col("folder_norm"))
    )
    reason = (
        F.when(F.array_contains(flags, "duplicate_source") | F.col("_copies").isNotNull(), "duplicate_source")
        .when(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in UNUSABLE_FLAGS])), "invalid_identifier")
        .when(no_key, "invalid_identifier")
        .when(F.col("_candidates").isNull(), "no_exact_candidate")
        .when(F.col("_candidates") > 1, "multiple_exact_candidates")
        .when((F.col("_kind") == "number") & conflict, "number_folder_conflict")
    )
    status = (
        F.when(F.col("_reason").isNull(), "matched")
        .when(F.col("_reason") == "no_exact_candidate", "unmatched")
        .when(F.col("_reason").isin("multiple_exact_candidates", "number_folder_conflict"), "ambiguous")
        .otherwise(F.col("_reason"))
    )
    first = joined.withColumn("_reason", reason).withColumn("_status", status)

    # Keys are unique among matched items of a scope, so at most two of them (one by number, one
    # by folder) meet on a target; unmatched items keep to themselves.
    slot = F.when(F.col("_status") == "matched", F.concat(F.lit("t"), F.col("_target"))).otherwise(
        F.concat(F.lit("i"), F.col("item_id"))
    )
    same_target = F.count(F.lit(1)).over(Window.partitionBy(*scope, "_slot"))
    second = first.withColumn("_slot", slot).withColumn("_same", same_target)
    doubled = (F.col("_status") == "matched") & (F.col("_same") > 1)
    final = second.withColumn("status", F.when(doubled, "duplicate_source").otherwise(F.col("_status")))
    matched = F.col("status") == "matched"
    method = F.when(F.col("_kind") == "number", "process_number_exact").otherwise("folder_exact_unique")
    return final.select(
        *manifest.columns,
        "status",
        F.when(matched, method).alias("method"),
        F.when(matched, F.col("_target")).alias("matched_id"),
        F.when(doubled, F.lit("duplicate_target")).otherwise(F.col("_reason")).alias("reason_code"),
    )


def summarize_status(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    total = F.count(F.lit(1)).alias("total")
    return results.groupBy(*by).agg(total, *counts) if by else results.agg(total, *counts)


def reconcile_corpus(manifest: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Outcome over the union of all documents, per document, and the exclusivity gate."""
    whole = summarize_status(reconcile(manifest, candidates))
    clean = (F.col("unmatched") + F.col("ambiguous") + F.col("duplicate_source")) == 0
    return {
        "corpus": whole.withColumn("exclusive", clean),
        "documents": summarize_status(reconcile(manifest, candidates, ["doc_id"]), ["doc_id"]),
    }


def snapshot_digest(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of the candidate projections."""
    columns = ["external_id", "number", "folder_norm", "record_digest", "customer_id"]
    return multiset_digest(with_keys(candidates), columns, by, "snapshot_sha256")


def snapshot_integrity(candidates: DataFrame, total: int, digest: str) -> DataFrame:
    """One row: does the snapshot have the stated total, unique ids and the stated digest?"""
    repeats = repeated_keys(candidates, ["external_id"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return snapshot_digest(candidates).select(
        (F.col("rows") == total).alias("total_ok"),
        (repeats == 0).alias("ids_unique"),
        (F.col("snapshot_sha256") == digest).alias("digest_ok"),
    )


def relevant_keys(manifest: DataFrame) -> DataFrame:
    """Distinct (kind, key) pairs of a manifest."""
    pairs = F.array(
        F.struct(F.lit("number").alias("kind"), F.col("number").alias("key")),
        F.struct(F.lit("folder").alias("kind"), F.col("folder_norm").alias("key")),
    )
    return with_keys(manifest).select(F.explode(pairs).alias("p")).select("p.*").filter("key is not null").distinct()


def relevant_candidates(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Candidates that share a number or folder with the manifest."""
    keyed = with_keys(candidates)

    def flag(kind: str, column: str) -> DataFrame:
        return keys.filter(F.col("kind") == kind).select(
            own_key(F.col("key"), F.lit("")).alias(f"_{column}"), F.lit(True).alias(f"_hit_{column}")
        )

    marked = keyed
    for kind, column in (("number", "number"), ("folder", "folder_norm")):
        marked = marked.withColumn(f"_{column}", own_key(F.col(column), F.col("external_id"))).join(
            flag(kind, column), f"_{column}", "left"
        )
    return marked.filter("_hit_number or _hit_folder_norm").select(*candidates.columns)


def snapshots_agree(first: DataFrame, second: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One row with ``agree``: two reads hold the same rows, or the same rows under the given keys."""
    if keys is not None:
        first, second = relevant_candidates(first, keys), relevant_candidates(second, keys)
    one, two = snapshot_digest(first), snapshot_digest(second)
    return one.select(
        F.col("rows").alias("first_rows"),
        two.select("rows").scalar().alias("second_rows"),
        (F.col("snapshot_sha256") == two.select("snapshot_sha256").scalar()).alias("agree"),
    )


def proposals(results: DataFrame, batches: DataFrame, snapshot_sha256: str) -> DataFrame:
    """Proposal rows: evidence and validity exist only for matched items."""
    matched = F.col("status") == "matched"
    evidence = F.sha2(
        F.concat_ws(":", "batch_id", "parser_version", F.lit(snapshot_sha256), "item_id", "matched_id", "method"), 256
    )
    return results.join(
        batches.select("batch_id", "parser_version", "period_start", "period_end"), "batch_id"
    ).select(
        "batch_id",
        "item_id",
        "status",
        F.when(matched, F.col("method")).alias("method"),
        F.when(matched, F.col("matched_id")).alias("matched_id"),
        F.when(matched, evidence).alias("evidence"),
        F.when(matched, F.col("period_start")).alias("proposed_from"),
        F.when(matched, F.col("period_end")).alias("proposed_to"),
    )


def manifest_complete(manifest: DataFrame, batches: DataFrame) -> DataFrame:
    """``complete`` per batch: declared row count, and ordinals exactly 1..n."""
    seen = manifest.groupBy("batch_id", "ordinal").agg(F.count(F.lit(1)).alias("_n")).groupBy("batch_id").agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min("ordinal").alias("_low"),
        F.max("ordinal").alias("_high"),
    )
    dense = (F.col("_low") == 1) & (F.col("_high") == F.col("rows")) & (F.col("_distinct") == F.col("rows"))
    return (
        batches.select("batch_id", "parsed_item_count")
        .join(seen, "batch_id", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
        .withColumn(
            "complete",
            (F.col("rows") == F.col("parsed_item_count")) & ((F.col("rows") == 0) | F.coalesce(dense, F.lit(False))),
        )
        .select("batch_id", "rows", "parsed_item_count", "complete")
    )


def flag_manifest(items: DataFrame) -> DataFrame:
    """Marks the second and later items with an equal key in a document, and items over several pages.

    The first item of a key is found by an aggregate that is joined back.
    """
    by_number = F.col("number").isNotNull()
    keyed = items.withColumn("_kind", F.when(by_number, "number").otherwise("folder")).withColumn(
        "_key", own_key(F.coalesce("number", "folder"), F.col("item_id"))
    )
    first = keyed.groupBy("doc_id", "_kind", "_key").agg(F.min("ordinal").alias("_first"))
    extra = codes(
        F.when(F.col("ordinal") > F.col("_first"), "duplicate_source"),
        F.when(F.col("page_end") > F.col("page_start"), HARMLESS_FLAG),
    )
    return (
        keyed.join(first, ["doc_id", "_kind", "_key"])
        .withColumn("quality_flags", F.array_sort(F.array_union("quality_flags", extra)))
        .drop("_kind", "_key", "_first")
    )


def duplicate_documents(documents: DataFrame, id_col: str, content: Column) -> DataFrame:
    """Documents whose content equals that of a document with a lower id, with that first id."""
    hashed = documents.select(F.col(id_col).alias("doc_id"), F.sha2(content, 256).alias("content_sha256"))
    first = hashed.groupBy("content_sha256").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("_n"))
    return hashed.join(first.filter("_n > 1").drop("_n"), "content_sha256").filter("doc_id > first_doc_id")


def resolve_for_approval(
    items: DataFrame, reviews: DataFrame, targets: DataFrame, runs: DataFrame, batches: DataFrame
) -> DataFrame:
    """Each item of a batch's latest run with its target, method and the reason that blocks it.

    Unmatched and ambiguous items follow their latest correction. Besides the item's own reason a
    repeated target in the batch blocks every item that points at it.

    Items stay where their batch is, those that may follow a correction then go by their id, and all go
    once by their target: it tells whether the target lives and, sorted, whether the batch repeats it.
    """
    current = latest_run(runs).select("batch_id", F.col("run_id").alias("_run"))
    states = batches.select("batch_id", F.col("state").alias("_state")).join(current, "batch_id")
    correction = latest_decision(reviews, "corrected").select(
        "item_id", F.col("after_id").alias("_after"), F.col("review_id").alias("_review")
    )
    live = targets.filter("status = 'active'").select(
        own_key(F.col("case_id"), F.lit("")).alias("_key"), F.lit(True).alias("_live")
    )
    matched = F.coalesce(F.col("status") == "matched", F.lit(False))
    follows = F.col("status").isin("unmatched", "ambiguous")
    reason = (
        F.when(F.col("_state") != "needs_review", "batch_state")
        .when(_blocking(F.col("quality_flags")), "manifest_flag")
        .when(matched & (F.col("evidence").isNull() | F.col("method").isNull()), "evidence_missing")
    )
    # Not an equality, which would be one more key and send the items by batch and run.
    newest = F.col("run_id").between(F.col("_run"), F.col("_run"))
    placed = items.join(states, "batch_id").filter(newest).withColumn("_reason", reason)

    own = ["batch_id", "run_id", "item_id", "target_id", "_review"]
    settled = placed.filter(matched).select(
        "batch_id", "run_id", "item_id", "_reason", F.col("matched_id").alias("target_id"), F.lit(None).cast("string").alias("_review"),
        F.lit(True).alias("_matched"), F.col("method").alias("link_method"), F.col("evidence").alias("_evidence"),
    )
    corrected = (
        placed.filter(~matched)
        .select("batch_id", "run_id", "item_id", "_reason", follows.alias("_follows"))
        .join(correction, "item_id", "left")
        .select(
            "batch_id", "run_id", "item_id", "_reason", F.when(F.col("_follows"), F.col("_after")).alias("target_id"), "_review",
            F.lit(False).alias("_matched"), F.lit("manual_existing_id").alias("link_method"), F.lit(None).cast("string").alias("_evidence"),
        )
    )
    picked = settled.unionByName(corrected).withColumn("_key", own_key(F.col("target_id"), F.col("item_id")))
    same = Window.partitionBy("_key", "batch_id").orderBy("item_id")
    repeated = F.lag(F.lit(True)).over(same).isNotNull() | F.lead(F.lit(True)).over(same).isNotNull()
    block = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("target_id").isNull(), "unresolved")
        .when(F.col("_live").isNull(), "target_inactive")
        .when(F.col("_repeated"), "target_repeated")
    )
    evidence = F.when(F.col("_matched"), F.col("_evidence")).otherwise(F.sha2(F.concat_ws(":", *own), 256))
    return (
        picked.join(live, "_key", "left")
        .withColumn("_repeated", repeated)
        .select("batch_id", "item_id", "target_id", "link_method", evidence.alias("link_evidence"), block.alias("block_reason"))
    )


def approvable_batches(resolved: DataFrame, batches: DataFrame) -> DataFrame:
    """``approvable`` per batch: every declared item is resolved and nothing blocks."""
    counts = resolved.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("items"), F.count("block_reason").alias("blocked")
    )
    return (
        batches.select("batch_id", "parsed_item_count")
        .join(counts, "batch_id")
        .withColumn("approvable", (F.col("blocked") == 0) & (F.col("items") == F.col("parsed_item_count")))
    )


def replace_period(batches: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Keeps the newest approved batch per partner and period; older ones are superseded.

    Links of superseded batches become inactive.
    """
    keys = ["partner_id", "period_start", "period_end"]
    approved = batches.filter("state = 'approved'")
    newest = approved.groupBy(*keys).agg(
        F.max(F.struct("created_at", "batch_id")).getField("batch_id").alias("superseded_by")
    )
    old = approved.join(newest, keys).filter("batch_id <> superseded_by").select("batch_id", "superseded_by")
    return {
        "batches": batches.join(old, "batch_id", "left").withColumn(
            "state", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("state"))
        ),
        "links": links.join(old.withColumnRenamed("superseded_by", "_by"), "batch_id", "left")
        .withColumn("status", F.when(F.col("_by").isNotNull(), "inactive").otherwise(F.col("status")))
        .drop("_by"),
    }


def fresh(runs: DataFrame, now: dt.datetime | str, max_age_minutes: int = SNAPSHOT_MAX_AGE_MINUTES) -> DataFrame:
    """Runs whose snapshot is not from the future and not older than the limit (pushed-down range)."""
    at = F.lit(str(now)).cast("timestamp")
    oldest = at - F.make_dt_interval(mins=F.lit(max_age_minutes))
    return runs.filter((F.col("snapshot_verified_at") <= at) & (F.col("snapshot_verified_at") >= oldest))


def covers_period(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """Runs whose snapshot was read on or after the last day of the batch's period."""
    joined = runs.join(batches.select("batch_id", "period_end"), "batch_id")
    return joined.filter(local_day(F.col("snapshot_verified_at")) >= F.col("period_end"))


def new_runs(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """Runs whose (batch, snapshot, parser) has no stored run yet."""
    keys = ["batch_id", "snapshot_sha256", "parser_version"]
    return runs.join(existing.select(*keys).distinct(), keys, "left_anti")


def activate_links(resolved: DataFrame, batches: DataFrame, reviewer: int, now: dt.datetime | str) -> DataFrame:
    """Link rows of unblocked items, valid for the batch's period."""
    period = batches.select("batch_id", "partner_id", "period_start", "period_end")
    return (
        resolved.filter("block_reason is null")
        .join(period, "batch_id")
        .select(
            "partner_id",
            F.lit("case").alias("entity_type"),
            F.col("target_id").alias("entity_id"),
            F.col("period_start").alias("valid_from"),
            F.col("period_end").alias("valid_to"),
            F.lit("active").alias("status"),
            F.lit("manifest").alias("source"),
            "batch_id",
            "item_id",
            F.col("link_method").alias("match_method"),
            F.col("link_evidence").alias("evidence"),
            F.lit(reviewer).cast("bigint").alias("reviewed_by"),
            F.lit(str(now)).cast("timestamp").alias("reviewed_at"),
        )
    )


def pending_decisions(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """A returned decision for each invalid item that has none yet."""
    keys = ["batch_id", "run_id", "item_id"]
    decided = reviews.filter(F.col("reason_code") == ACCEPTED_PENDING).select(*keys).distinct()
    return (
        items.filter("status = 'invalid_identifier'")
        .join(decided, keys, "left_anti")
        .select(*keys, F.lit("returned").alias("decision"), F.lit(ACCEPTED_PENDING).alias("reason_code"))
    )


def parse_outcome(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per document: item counts and the next state of its import.

    ``documents`` carries stored and computed hash and page count; a difference rejects it.
    """
    found = manifest.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged"),
        F.count_if(_blocking(F.col("quality_flags"))).alias("_blocking"),
    )
    same = (F.col("stored_sha256") == F.col("content_sha256")) & (F.col("stored_pages") == F.col("pages"))
    needs_review = (F.col("items") == 0) | (F.col("_blocking") > 0)
    zero = F.lit(0).cast("bigint")
    return (
        documents.join(found, "doc_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("items", "flagged", "_blocking")})
        .withColumn(
            "next_state", F.when(~same, "rejected").when(needs_review, "needs_review").otherwise("parsed")
        )
        .select("doc_id", "items", "flagged", "next_state")
    )


def new_requests(revisions: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """``decision`` per revision: done, already_active, conflict or queue."""
    keys = ["partner_id", "batch_id", "source_digest"]
    made = versions.select(*keys).distinct().withColumn("_made", F.lit(True))
    active = requests.filter(F.col("status").isin(*ACTIVE))
    same = active.select(*keys).distinct().withColumn("_same", F.lit(True))
    other = active.select("partner_id").distinct().withColumn("_busy", F.lit(True))
    decision = (
        F.when(F.col("_made"), "done")
        .when(F.col("_same"), "already_active")
        .when(F.col("_busy"), "conflict")
        .otherwise("queue")
    )
    return (
        revisions.join(made, keys, "left")
        .join(same, keys, "left")
        .join(other, "partner_id", "left")
        .withColumn("decision", decision)
        .drop("_made", "_same", "_busy")
    )


def correctable(items: DataFrame, runs: DataFrame, targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted corrections (item_id, after_id) that are allowed.

    The item belongs to the latest run of its batch, is unmatched or ambiguous, and the new target
    is active.
    """
    current = latest_run(runs).select("batch_id", "run_id")
    open_items = items.filter(F.col("status").isin("unmatched", "ambiguous")).join(
        current, ["batch_id", "run_id"], "left_semi"
    )
    live = targets.filter("status = 'active'").select(F.col("case_id").alias("after_id"))
    return wanted.join(open_items.select("item_id"), "item_id", "left_semi").join(live, "after_id", "left_semi")
