"""Temporal partner links: effect, classification, eligibility and change propagation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.availability import availability, gated
from folioscope.operators.spread import first_rows, positions, repeated_keys

FAR_DAY = "9999-12-31"
SYNTHETIC_PREFIX = "SYNTHETIC-"


def effective_on(links: DataFrame, day: dt.date | str) -> DataFrame:
    """Active links whose closed validity interval contains ``day``; a plain pushed-down filter."""
    at = F.lit(str(day)).cast("date")
    return links.filter(
        (F.col("status") == "active")
        & (F.col("valid_from") <= at)
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))
    )


def partner_span(links: DataFrame, entity_type: str) -> DataFrame:
    """Lowest and highest partner per entity: enough to tell none, one and many apart."""
    return (
        links.filter(F.col("entity_type") == entity_type)
        .groupBy("entity_id")
        .agg(F.min("partner_id").alias("first_partner"), F.max("partner_id").alias("last_partner"))
    )


def case_partner_span(case_customers: DataFrame, links: DataFrame) -> DataFrame:
    """Lowest and highest partner per case over direct links and links of its customers.

    The span replaces the partner set wherever only its size class matters, so a customer with
    many cases adds one row per case and nothing is collected.
    """
    of_customers = partner_span(links, "customer").withColumnRenamed("entity_id", "customer_id")
    via = case_customers.join(of_customers, "customer_id").select("case_id", "first_partner", "last_partner")
    direct = partner_span(links, "case").withColumnRenamed("entity_id", "case_id")
    return (
        via.unionByName(direct)
        .groupBy("case_id")
        .agg(F.min("first_partner").alias("first_partner"), F.max("last_partner").alias("last_partner"))
    )


def link_class() -> Column:
    return (
        F.when(F.col("first_partner").isNull(), "unlinked")
        .when(F.col("first_partner") == F.col("last_partner"), "linked")
        .otherwise("multiple")
    )


def unknown_targets(links: DataFrame, customers: DataFrame, cases: DataFrame) -> DataFrame:
    """Links whose target does not exist."""
    known = customers.select(F.lit("customer").alias("entity_type"), F.col("customer_id").alias("entity_id"))
    known = known.unionByName(cases.select(F.lit("case").alias("entity_type"), F.col("case_id").alias("entity_id")))
    return links.join(known, ["entity_type", "entity_id"], "left_anti")


def validate_linkage(
    customers: DataFrame, case_customers: DataFrame, cases: DataFrame, mappings: DataFrame, day: dt.date | str
) -> DataFrame:
    """One row per entity type: total, linked, unlinked, multiple and nonexistent targets.

    Nonexistent targets count every mapping, also ineffective ones.
    """
    active = effective_on(mappings, day)
    own = customers.select("customer_id").join(
        partner_span(active, "customer").withColumnRenamed("entity_id", "customer_id"), "customer_id", "left"
    )
    of_cases = cases.select("case_id").join(case_partner_span(case_customers, active), "case_id", "left")
    classes = own.select(F.lit("customer").alias("entity_type"), link_class().alias("class")).unionByName(
        of_cases.select(F.lit("case").alias("entity_type"), link_class().alias("class"))
    )
    counts = classes.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("class") == c).alias(c) for c in ("linked", "unlinked", "multiple")],
    )
    lost = unknown_targets(mappings, customers, cases).groupBy("entity_type").agg(F.count(F.lit(1)).alias("nonexistent"))
    return counts.join(lost, "entity_type", "left").withColumn(
        "nonexistent", F.coalesce("nonexistent", F.lit(0).cast("bigint"))
    )


def known_case_customers(case_customers: DataFrame, customers: DataFrame) -> DataFrame:
    return case_customers.join(customers.select("customer_id"), "customer_id", "left_semi")


def missing_customer_refs(case_customers: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct references of a case to customers that are not in the source."""
    return (
        case_customers.select("case_id", "customer_id").distinct().join(customers.select("customer_id"), "customer_id", "left_anti")
    )


def case_partner_sets(
    cases: DataFrame, case_customers: DataFrame, customers: DataFrame, links: DataFrame, day: dt.date | str
) -> DataFrame:
    """Distinct (case_id, partner_id): direct links and links of the case's known customers."""
    active = effective_on(links, day)
    of_customers = (
        active.filter("entity_type = 'customer'").select(F.col("entity_id").alias("customer_id"), "partner_id").distinct()
    )
    via = known_case_customers(case_customers, customers).join(of_customers, "customer_id").select("case_id", "partner_id")
    direct = active.filter("entity_type = 'case'").select(F.col("entity_id").alias("case_id"), "partner_id")
    return via.unionByName(direct).join(cases.select("case_id"), "case_id", "left_semi").distinct()


def eligible_cases(
    cases: DataFrame, case_customers: DataFrame, customers: DataFrame, links: DataFrame, day: dt.date | str
) -> DataFrame:
    """(partner_id, case_id) of cases that belong to exactly one partner."""
    span = case_partner_span(known_case_customers(case_customers, customers), effective_on(links, day))
    return (
        span.filter("first_partner = last_partner")
        .select(F.col("first_partner").alias("partner_id"), "case_id")
        .join(cases.select("case_id"), "case_id", "left_semi")
    )


def eligible_customers(
    eligible: DataFrame, case_customers: DataFrame, customers: DataFrame, links: DataFrame, day: dt.date | str
) -> DataFrame:
    """(partner_id, customer_id): exclusive customers and known customers of eligible cases."""
    own = (
        partner_span(effective_on(links, day), "customer")
        .filter("first_partner = last_partner")
        .select(F.col("first_partner").alias("partner_id"), F.col("entity_id").alias("customer_id"))
        .join(customers.select("customer_id"), "customer_id", "left_semi")
    )
    of_cases = eligible.join(known_case_customers(case_customers, customers), "case_id").select("partner_id", "customer_id")
    return own.unionByName(of_cases).distinct()


def portfolio_quality(
    partners: DataFrame,
    cases: DataFrame,
    case_customers: DataFrame,
    customers: DataFrame,
    links: DataFrame,
    latest_movements: DataFrame,
    day: dt.date | str,
) -> DataFrame:
    """Quality counters of every partner's portfolio."""
    active = effective_on(links, day)
    known = known_case_customers(case_customers, customers)
    span = case_partner_span(known, active).join(cases.select("case_id"), "case_id", "left_semi")
    eligible = span.filter("first_partner = last_partner").select(F.col("first_partner").alias("partner_id"), "case_id")
    shared = span.filter("first_partner < last_partner").select("case_id")
    sets = case_partner_sets(cases.join(shared, "case_id", "left_semi"), case_customers, customers, links, day)

    # One row per eligible case with what it lacks, counted in one pass.
    moved = latest_movements.select("case_id", F.lit(True).alias("_moved"))
    lacking = missing_customer_refs(case_customers, customers).groupBy("case_id").agg(F.count(F.lit(1)).alias("_missing"))
    of_cases = (
        eligible.join(moved, "case_id", "left")
        .join(lacking, "case_id", "left")
        .groupBy("partner_id")
        .agg(
            F.count(F.lit(1)).alias("eligible_cases"),
            F.count_if(F.col("_moved").isNull()).alias("missing_movements"),
            F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_customer_references"),
        )
    )

    def count_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("partner_id").agg(F.count(F.lit(1)).alias(name))

    counters = [
        of_cases,
        count_of(sets, "ambiguous_cases"),
        count_of(unknown_targets(active, customers, cases), "nonexistent_links"),
    ]
    result = partners.select("partner_id")
    for counter in counters:
        result = result.join(counter, "partner_id", "left")
    return result.fillna(0)


def source_quality(
    cases: DataFrame, case_customers: DataFrame, customers: DataFrame, links: DataFrame, day: dt.date | str
) -> DataFrame:
    """One row of counters over the whole source."""
    active = effective_on(links, day)
    span = cases.select("case_id").join(
        case_partner_span(known_case_customers(case_customers, customers), active), "case_id", "left"
    )
    return span.agg(F.count_if(F.col("first_partner").isNull()).alias("unlinked_cases")).select(
        "unlinked_cases",
        missing_customer_refs(case_customers, customers).agg(F.count(F.lit(1)).alias("n")).scalar().alias(
            "missing_customer_references"
        ),
        unknown_targets(active, customers, cases).agg(F.count(F.lit(1)).alias("n")).scalar().alias("nonexistent_links"),
    )


def technical_gate(quality: DataFrame, source_complete: Column, approved: Column) -> DataFrame:
    """Adds ``ready``: complete, approved, and without ambiguous cases or lost links."""
    clean = (F.col("ambiguous_cases") == 0) & (F.col("nonexistent_links") == 0)
    return quality.withColumn("ready", source_complete & approved & clean)


def apply_gate(values: DataFrame, columns: dict[str, str], as_of: Column, ready: str = "ready") -> DataFrame:
    """Wraps value columns (name -> source); behind a closed gate they become pending."""
    wrapped = {
        name: gated(
            availability(F.col(name), source, as_of), F.col(ready), source, "linkage_not_approved_or_conflict"
        )
        for name, source in columns.items()
    }
    return values.withColumns(wrapped)


def anonymous_refs(df: DataFrame, partner_col: str, id_col: str, prefix: str) -> DataFrame:
    """Adds ``reference`` such as C-001: position by id inside the partner, at least three digits."""
    numbered = positions(df, [partner_col], id_col, "_position")
    return numbered.withColumn("reference", F.format_string(f"{prefix}-%03d", "_position")).drop("_position")


def related_refs(case_customers: DataFrame, case_refs: DataFrame, customer_refs: DataFrame) -> DataFrame:
    """(partner_id, case_reference, customer_reference) pairs, the relational form of both lists."""
    left = case_refs.select("partner_id", "case_id", F.col("reference").alias("case_reference"))
    right = customer_refs.select("partner_id", "customer_id", F.col("reference").alias("customer_reference"))
    return (
        left.join(case_customers, "case_id")
        .join(right, ["partner_id", "customer_id"])
        .select("partner_id", "case_reference", "customer_reference")
    )


def preview_alerts(quality: DataFrame) -> DataFrame:
    """One row per alert and partner: counted codes above zero, and the fixed pending one."""
    pairs = F.array(
        F.struct(F.lit("missing_movement").alias("code"), F.col("missing_movements").alias("count")),
        F.struct(
            F.lit("missing_customer_reference").alias("code"), F.col("missing_customer_references").alias("count")
        ),
        F.struct(F.lit("freshness_threshold_pending").alias("code"), F.lit(None).cast("bigint").alias("count")),
    )
    return (
        quality.select("partner_id", F.explode(pairs).alias("alert"))
        .select("partner_id", "alert.code", "alert.count")
        .filter("count is null or count > 0")
    )


def affected_partners(
    changed_customers: DataFrame, changed_cases: DataFrame, case_customers: DataFrame, links: DataFrame, day: dt.date | str
) -> DataFrame:
    """Partners whose portfolio shows one of the changed customers or cases."""
    return partners_showing(
        changed_customers,
        changed_cases,
        case_customers.join(changed_customers, "customer_id", "left_semi"),
        case_customers.join(changed_cases, "case_id", "left_semi"),
        links,
        day,
    )


def partners_showing(
    customers: DataFrame,
    cases: DataFrame,
    pairs_of_customers: DataFrame,
    pairs_of_cases: DataFrame,
    links: DataFrame,
    day: dt.date | str,
) -> DataFrame:
    """Partners linked to one of the customers or cases, to a case of those customers or a customer of those cases."""
    def entities(kind: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"))

    touched = (
        entities("customer", customers, "customer_id")
        .unionByName(entities("case", pairs_of_customers, "case_id"))
        .unionByName(entities("case", cases, "case_id"))
        .unionByName(entities("customer", pairs_of_cases, "customer_id"))
    )
    hit = effective_on(links, day).join(touched.distinct(), ["entity_type", "entity_id"], "left_semi")
    return hit.select("partner_id").distinct()


def overlapping_links(links: DataFrame) -> DataFrame:
    """Active links that overlap an earlier link of the same entity.

    Links are first reduced to one row per entity and start day. The running maximum then only
    sees days, so an entity with very many links does not become one huge window.
    """
    active = links.filter("status = 'active'").withColumn(
        "_to", F.coalesce("valid_to", F.to_date(F.lit(FAR_DAY)))
    )
    days = active.groupBy("entity_type", "entity_id", "valid_from").agg(
        F.max("_to").alias("_day_to"), F.min("link_id").alias("_day_first")
    )
    earlier = Window.partitionBy("entity_type", "entity_id").orderBy("valid_from").rowsBetween(
        Window.unboundedPreceding, -1
    )
    reach = days.withColumn("_reach", F.max("_day_to").over(earlier)).drop("_day_to")
    clash = (F.col("_reach") >= F.col("valid_from")) | (F.col("link_id") != F.col("_day_first"))
    return (
        active.join(reach, ["entity_type", "entity_id", "valid_from"])
        .filter(clash)
        .drop("_to", "_reach", "_day_first")
    )


def check_link_targets(links: DataFrame, customers: DataFrame, cases: DataFrame) -> DataFrame:
    """Links with a ``violation``: target count, target type, unknown target, identifier or period."""
    known = customers.select(F.lit("customer").alias("_kind"), F.col("customer_id").alias("_target"))
    known = known.unionByName(cases.select(F.lit("case").alias("_kind"), F.col("case_id").alias("_target")))
    targets = F.col("customer_id").isNotNull().cast("int") + F.col("case_id").isNotNull().cast("int")
    kind = F.when(F.col("customer_id").isNotNull(), F.lit("customer")).otherwise(F.lit("case"))
    violation = (
        F.when(targets != 1, "target_count")
        .when(F.col("entity_type") != F.col("_kind"), "target_type")
        .when(F.col("_found").isNull(), "target_unknown")
        .when(F.col("entity_id") != F.col("_target"), "target_identifier")
        .when(F.col("valid_to") < F.col("valid_from"), "period")
    )
    return (
        links.withColumn("_kind", kind)
        .withColumn("_target", F.coalesce("customer_id", "case_id"))
        .join(known.withColumn("_found", F.lit(True)), ["_kind", "_target"], "left")
        .withColumn("violation", violation)
        .filter("violation is not null")
        .drop("_kind", "_target", "_found")
    )


def check_links_match_review(links: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds ``consistent``: a link repeats the matched proposal or the item's latest correction."""
    correction = first_rows(
        reviews.filter("decision = 'corrected'"), ["item_id"], [F.col("review_revision").desc()]
    ).select("item_id", F.col("after_id").alias("_after"))
    proposal = items.select(
        "item_id",
        F.col("status").alias("_status"),
        F.col("matched_id").alias("_matched"),
        F.col("method").alias("_method"),
        F.col("evidence").alias("_evidence"),
    )
    same = (
        F.col("entity_id").eqNullSafe(F.col("_matched"))
        & F.col("match_method").eqNullSafe(F.col("_method"))
        & F.col("link_evidence").eqNullSafe(F.col("_evidence"))
    )
    corrected = (F.col("match_method") == "manual_existing_id") & (F.col("entity_id") == F.col("_after"))
    consistent = F.when(F.col("_status") == "matched", same).otherwise(F.coalesce(corrected, F.lit(False)))
    return (
        links.withColumnRenamed("evidence", "link_evidence")
        .join(proposal, "item_id", "left")
        .join(correction, "item_id", "left")
        .withColumn("consistent", consistent)
        .select("link_id", "item_id", "batch_id", "consistent")
    )


def governed_mappings(partners: DataFrame, links: DataFrame, day: dt.date | str) -> DataFrame:
    """Distinct effective mappings of active, non-synthetic partners."""
    live = partners.filter((F.col("status") == "active") & ~F.col("code").startswith(SYNTHETIC_PREFIX))
    return (
        effective_on(links, day)
        .join(live.select("partner_id"), "partner_id", "left_semi")
        .select("entity_type", "entity_id", "partner_id")
    )


def in_scope(partners: DataFrame, scope: str) -> DataFrame:
    """Synthetic partners, or real partners that are released for the pilot."""
    synthetic = F.col("external_id").startswith(SYNTHETIC_PREFIX)
    if scope == "synthetic":
        return partners.filter(synthetic)
    if scope == "pilot":
        return partners.filter(F.col("pilot_enabled") & ~synthetic)
    raise ValueError(f"unknown scope {scope!r}")


def minimal_snapshot(results: DataFrame, candidates: DataFrame, case_customers: DataFrame) -> dict[str, DataFrame]:
    """Only matched cases, their customer pairs and customers; ``lost`` must stay empty."""
    matched = results.filter("status = 'matched'").select(F.col("matched_id").alias("external_id")).distinct()
    cases = candidates.join(matched, "external_id", "left_semi")
    pairs = case_customers.join(matched.withColumnRenamed("external_id", "case_id"), "case_id", "left_semi")
    return {
        "cases": cases,
        "case_customers": pairs,
        "customers": pairs.select("customer_id").distinct(),
        "lost": matched.join(candidates, "external_id", "left_anti"),
    }


def enrichment_coverage(
    results: DataFrame, case_customers: DataFrame, customers: DataFrame, transactions: DataFrame, movements: DataFrame
) -> DataFrame:
    """One row of counts for the matched cases; ``repeated_transactions`` above zero is an error."""
    matched = results.filter("status = 'matched'").select(F.col("matched_id").alias("case_id")).distinct()
    referenced = case_customers.join(matched, "case_id", "left_semi").select("customer_id").distinct()
    entries = transactions.join(matched, "case_id", "left_semi")

    def size(rows: DataFrame) -> Column:
        return rows.agg(F.count(F.lit(1)).alias("n")).scalar()

    return referenced.agg(F.count(F.lit(1)).alias("referenced_customers")).select(
        "referenced_customers",
        size(customers.join(referenced, "customer_id", "left_semi")).alias("customers_found"),
        size(entries.select("entry_id").distinct()).alias("transactions_found"),
        size(movements.join(matched, "case_id", "left_semi")).alias("movements_found"),
        size(repeated_keys(entries, ["entry_id"])).alias("repeated_transactions"),
    )
