"""Count-only quality summaries: no identifiers and no values leave them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.links import case_partner_span, link_class, unknown_targets

# Movement-age classes by number of days.
AGE_CLASSES = ((30, "0_30_days"), (90, "31_90_days"), (180, "91_180_days"), (365, "181_365_days"))


def customers_with_many_cases(case_customers: DataFrame) -> DataFrame:
    """One row: customers that occur in more than one case."""
    per_customer = case_customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.agg(F.count_if(F.col("n") > 1).alias("customers_with_many_cases"))


def quality_summary(
    partners: DataFrame, customers: DataFrame, cases: DataFrame, case_customers: DataFrame, mappings: DataFrame
) -> DataFrame:
    """One row of counts; ``mappings`` are effective links of governed partners."""
    lost = unknown_targets(mappings, customers, cases)
    span = case_partner_span(
        case_customers.join(customers.select("customer_id"), "customer_id", "left_semi"), mappings
    )
    classes = cases.select("case_id", "process_number").join(span, "case_id", "left").withColumn("class", link_class())
    owners = classes.filter("class = 'linked'").select(F.col("first_partner").alias("partner_id")).distinct()
    with_cases = partners.join(owners, "partner_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    total = partners.agg(F.count(F.lit(1)).alias("n")).scalar()
    return classes.agg(
        F.count_if(F.col("class") == "linked").alias("linked"),
        F.count_if(F.col("class") == "unlinked").alias("unlinked"),
        F.count_if(F.col("class") == "multiple").alias("conflicts"),
        F.count_if(F.col("process_number").isNull()).alias("missing_number"),
    ).select(
        total.alias("partners_total"),
        with_cases.alias("partners_with_cases"),
        (total - with_cases).alias("partners_without_cases"),
        "linked",
        "unlinked",
        "conflicts",
        "missing_number",
        customers_with_many_cases(case_customers).scalar().alias("customers_with_many_cases"),
        lost.agg(F.count(F.lit(1)).alias("n")).scalar().alias("mappings_not_found"),
    )


def movement_age(cases: DataFrame, movements: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Cases per age class of their last movement; a later last movement counts as future_dated.

    The last movement is the one with the latest instant; its age counts from ``occurred_on``, the day
    that its own offset shows.
    """
    last = movements.groupBy("case_id").agg(F.max(F.struct("occurred_at", "occurred_on"))["occurred_on"].alias("_last"))
    days = F.datediff(F.lit(str(as_of)).cast("date"), F.col("_last"))
    age = F.when(F.col("_last").isNull(), "without_movement").when(days < 0, "future_dated")
    for limit, name in AGE_CLASSES:
        age = age.when(days <= limit, name)
    return (
        cases.select("case_id")
        .join(last, "case_id", "left")
        .groupBy(age.otherwise("over_365_days").alias("age"))
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def financial_coverage(cases: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row: available and missing amounts, orphan records, and cases with none, some or many.

    Records are counted per case id before the join, so records without a case are one row.
    """
    per_case = transactions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_records"), F.count("amount").alias("_available")
    )
    known = cases.select("case_id", F.lit(True).alias("_known"))
    both = per_case.join(known, "case_id", "left")
    is_known = F.col("_known").isNotNull()
    total_cases = cases.agg(F.count(F.lit(1)).alias("n")).scalar()
    return both.agg(
        F.sum("_available").alias("records_available"),
        F.sum(F.col("_records") - F.col("_available")).alias("records_not_provided"),
        F.coalesce(F.sum(F.when(~is_known, F.col("_records"))), F.lit(0)).alias("orphan_records"),
        F.count_if(is_known).alias("cases_with_records"),
        F.count_if(is_known & (F.col("_records") > 1)).alias("cases_with_multiple_records"),
    ).withColumn("cases_without_records", total_cases - F.col("cases_with_records"))


def status_counts(queue: DataFrame, partners: DataFrame, status_col: str = "status") -> DataFrame:
    """Rows per status for the given partners, counted per partner before the join."""
    small = queue.groupBy("partner_id", status_col).agg(F.count(F.lit(1)).alias("n"))
    return small.join(partners.select("partner_id"), "partner_id", "left_semi").groupBy(status_col).agg(F.sum("n").alias("n"))


def distribution(df: DataFrame, key_col: str) -> DataFrame:
    """Count and whole percent (ties to even) per key; empty with fewer than two keys."""
    counts = df.filter(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("keys"))
    total, keys = totals.select("total").scalar(), totals.select("keys").scalar()
    percent = F.bround(F.lit(100) * F.col("count") / total, 0).cast("bigint")
    return counts.filter((keys >= 2) & (total > 0)).withColumn("percent", percent).orderBy("label")


def users_with_role(users: DataFrame, user_roles: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """One row: active users that hold the role."""
    holders = user_roles.join(roles.filter(F.col("role") == role).select("role_id"), "role_id", "left_semi")
    return users.filter("status = 'active'").join(holders, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("users"))


def corpus_summary(documents: DataFrame, content: Column) -> DataFrame:
    """(measure, key, n) over a document corpus with pages, items, flags, item_flags and rejection.

    Only accepted documents add pages, items, flags and distinct contents.
    """
    accepted = documents.filter("rejection is null")
    numbers = accepted.agg(
        F.count_distinct(F.sha2(content, 256)).alias("unique_sources"),
        F.coalesce(F.sum("pages"), F.lit(0)).cast("bigint").alias("page_count"),
        F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("manifest_items"),
    ).select(
        documents.agg(F.count(F.lit(1)).alias("n")).scalar().alias("source_files"),
        "unique_sources",
        "page_count",
        "manifest_items",
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.lit("").alias("key"), F.col(c).alias("n")) for c in numbers.columns])
    totals = numbers.select(F.explode(pairs).alias("p")).select("p.*")

    def histogram(rows: DataFrame, measure: str) -> DataFrame:
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), "key", "n")

    flags = accepted.select(F.explode(F.concat("flags", "item_flags")).alias("key"))
    rejected = documents.filter("rejection is not null").select(F.col("rejection").alias("key"))
    return totals.unionByName(histogram(flags, "quality_flag")).unionByName(histogram(rejected, "rejected"))
