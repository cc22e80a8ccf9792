"""Strict, allow-listed normalisation of raw records (a VARIANT column ``record``).

Every frame keeps its technical columns and gains the normalised fields and ``errors``, the list
of broken rules. Nothing else of the raw record survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scalars as s
from folioscope.operators.spread import first_rows

# Text limits of report labels.
STEP_LIMIT = 120
CONTINGENCY_LIMIT = 80


RELATED = "customers"


def _opened(raw: DataFrame, names: Sequence[str], related: bool = False) -> DataFrame:
    """Opens the record's attributes; ``related`` also opens the list of customer entries."""
    extra = []
    if related:
        source = s.field("record", RELATED)
        entries = F.try_variant_get(F.col("record"), f"$.{RELATED}", "array<variant>")
        extra = [source.isNotNull().alias("_related_given"), s.open_list(entries, ENTRY_ATTRIBUTES).alias("_related")]
    return s.open_record(raw, names, extra=extra)


def _project(opened: DataFrame, fields: dict[str, Column], errors: Sequence[Column]) -> DataFrame:
    kept = [c for c in opened.columns if not c.startswith("_")]
    return opened.select(
        *kept, *[c.alias(n) for n, c in fields.items()], s.codes(*errors).alias("errors")
    )


def _get(name: str) -> s.Raw:
    return s.opened(name)


def _text_errors(*names: str) -> list[Column]:
    return [s.text_error(_get(n), n) for n in names]


# The attributes that survive, by resource.
CUSTOMER_ATTRIBUTES = ("id", "name", "identification", "origin", "created_at")
CASE_ATTRIBUTES = (
    "id", "process_number", "protocol_number", "folder", "group_id", "type_lawsuit_id", "stages_id", "responsible_id",
    "process_date", "created_at", "type", "stage", "step", "responsible", "contingency", "fees_expec",
)
TRANSACTION_ATTRIBUTES = (
    "id", "lawsuit_id", "amount", "entry_type", "category", "description", "cost_center", "competence", "date_due",
    "date_payment", "is_internal",
)
MOVEMENT_ATTRIBUTES = ("lawsuit_id", "date", "title")
ENTRY_ATTRIBUTES = ("customer_id", "name", "origin")


def normalize_customers(raw: DataFrame) -> DataFrame:
    return _project(
        _opened(raw, CUSTOMER_ATTRIBUTES),
        {
            "external_id": s.positive_id(_get("id")),
            "name": s.text_or_null(_get("name")),
            "identification": s.text_or_null(_get("identification")),
            "origin": s.text_or_null(_get("origin")),
            "source_created_at": s.iso_timestamp(_get("created_at")),
        },
        [
            s.positive_id_error(_get("id"), "id", required=True),
            *_text_errors("name", "identification", "origin"),
            s.iso_timestamp_error(_get("created_at"), "created_at"),
        ],
    )


def related_customer_ids() -> Column:
    """Sorted distinct usable customer ids of a case record."""
    ids = F.transform("_related", lambda r: s.positive_id(s.entry_value(r, "customer_id")))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(ids))), F.array().cast("array<bigint>"))


def _related_names() -> Column:
    """id -> name in id order; of several entries for one id the last one counts."""
    numbered = F.transform(
        "_related",
        lambda r, i: F.struct(
            s.positive_id(s.entry_value(r, "customer_id")).alias("id"), i.alias("at"), s.short_text(s.entry_value(r, "name")).alias("name")
        ),
    )
    ordered = F.array_sort(F.filter(numbered, lambda e: e["id"].isNotNull()))
    # In id order an entry is the last one of its id when the next entry has another id.
    last = F.filter(
        F.transform(
            ordered, lambda e, i: F.struct(e["id"].alias("id"), e["name"].alias("name"), F.get(ordered, i + 1)["id"].alias("next"))
        ),
        lambda e: e["next"].isNull() | (e["next"] != e["id"]),
    )
    pairs = F.transform(last, lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name")))
    return F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<id:bigint,name:string>>")))


def _related_error() -> Column:
    """Not a list (a missing list is fine), a foreign entry, a bad id, or a bad name of a usable id."""
    def broken(entry: Column) -> Column:
        source_id, name = s.entry_value(entry, "customer_id"), s.entry_value(entry, "name")
        bad_name = s.positive_id(source_id).isNotNull() & s.text_error(name, "x").isNotNull()
        return ~entry["is_object"] | s.positive_id_error(source_id, "x").isNotNull() | bad_name

    not_a_list = F.col("_related_given") & F.col("_related").isNull()
    return F.when(not_a_list | F.coalesce(F.exists("_related", broken), F.lit(False)), F.lit("customers_invalid"))


def _case_fields() -> dict[str, Column]:
    return {
        "external_id": s.positive_id(_get("id")),
        "process_number": s.text_or_null(_get("process_number")),
        "protocol_number": s.text_or_null(_get("protocol_number")),
        "folder": s.text_or_null(_get("folder")),
        "group_id": s.positive_id(_get("group_id")),
        "type_id": s.positive_id(_get("type_lawsuit_id")),
        "stage_id": s.positive_id(_get("stages_id")),
        "responsible_id": s.positive_id(_get("responsible_id")),
        "process_date": s.iso_date(_get("process_date")),
        "source_created_at": s.iso_timestamp(_get("created_at")),
        "type_label": s.short_text(_get("type")),
        "stage_label": s.short_text(_get("stage")),
        "step_label": s.short_text(_get("step"), STEP_LIMIT),
        "responsible_name": s.short_text(_get("responsible")),
        "contingency": s.short_text(_get("contingency"), CONTINGENCY_LIMIT),
        "fees_expected": s.money(_get("fees_expec")),
        "customer_ids": related_customer_ids(),
        "customer_names": _related_names(),
    }


def normalize_cases(raw: DataFrame) -> DataFrame:
    return _project(
        _opened(raw, CASE_ATTRIBUTES, related=True),
        _case_fields(),
        [
            s.positive_id_error(_get("id"), "id", required=True),
            *_text_errors(
                "process_number", "protocol_number", "folder", "type", "stage", "step", "responsible", "contingency"
            ),
            *[s.positive_id_error(_get(n), n) for n in ("group_id", "type_lawsuit_id", "stages_id", "responsible_id")],
            s.iso_date_error(_get("process_date"), "process_date"),
            s.iso_timestamp_error(_get("created_at"), "created_at"),
            s.money_error(_get("fees_expec"), "fees_expec"),
            _related_error(),
        ],
    )


def normalize_transactions(raw: DataFrame) -> DataFrame:
    """An absent amount is not_provided, never zero."""
    amount = s.money(_get("amount"))
    return _project(
        _opened(raw, TRANSACTION_ATTRIBUTES),
        {
            "external_id": s.positive_id(_get("id")),
            "case_external_id": s.positive_id(_get("lawsuit_id")),
            "amount": amount,
            "amount_status": F.when(amount.isNull(), "not_provided").otherwise("available"),
            "entry_type": s.text_or_null(_get("entry_type")),
            "category": s.text_or_null(_get("category")),
            "description": s.short_text(_get("description")),
            "cost_center": s.text_or_null(_get("cost_center")),
            "competence": s.text_or_null(_get("competence")),
            "date_due": s.iso_date(_get("date_due")),
            "date_payment": s.iso_date(_get("date_payment")),
            "is_internal": s.flag(_get("is_internal")),
        },
        [
            s.positive_id_error(_get("id"), "id", required=True),
            s.positive_id_error(_get("lawsuit_id"), "lawsuit_id"),
            s.money_error(_get("amount"), "amount", blank_ok=False),
            *_text_errors("entry_type", "category", "description", "cost_center", "competence"),
            s.iso_date_error(_get("date_due"), "date_due"),
            s.iso_date_error(_get("date_payment"), "date_payment"),
            s.flag_error(_get("is_internal"), "is_internal"),
        ],
    )


def movement_fingerprint(case_id: Column, occurred_at: Column, title: Column) -> Column:
    """SHA-256 over case, instant and title; spellings of one instant are the same movement."""
    instant = F.date_format(F.to_utc_timestamp(occurred_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parts = F.array(case_id.cast("string"), instant, title)
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def normalize_movements(raw: DataFrame) -> DataFrame:
    case_id, occurred_at = s.positive_id(_get("lawsuit_id")), s.iso_timestamp(_get("date"))
    title = s.text_or_null(_get("title"))
    return _project(
        _opened(raw, MOVEMENT_ATTRIBUTES),
        {
            "case_external_id": case_id,
            "occurred_at": occurred_at,
            "title": title,
            "fingerprint": movement_fingerprint(case_id, occurred_at, title),
        },
        [
            s.positive_id_error(_get("lawsuit_id"), "lawsuit_id", required=True),
            s.iso_timestamp_error(_get("date"), "date", required=True),
            *_text_errors("title"),
        ],
    )


NORMALIZERS = {
    "customers": (normalize_customers, "external_id"),
    "lawsuits": (normalize_cases, "external_id"),
    "transactions": (normalize_transactions, "external_id"),
    "last_movements": (normalize_movements, "fingerprint"),
}


def split_rejects(normalized: DataFrame) -> DataFrame:
    """Adds ``side``, accepted or rejected; of rejected rows only technical columns and errors are left.

    One frame for both sides, so that the records are normalised once; written partitioned by side,
    each side is read alone.
    """
    clean = F.size("errors") == 0
    kept = ("requested_offset", "position", "seq", "errors")
    columns = [F.col(c) if c in kept else F.when(clean, F.col(c)).alias(c) for c in normalized.columns]
    return normalized.select(*columns, F.when(clean, "accepted").otherwise("rejected").alias("side"))


def first_accepted(accepted: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key; later copies are duplicates."""
    return first_rows(accepted, [key], [F.col(c) for c in order])


def with_identifier_fallback(raw: DataFrame) -> DataFrame:
    """Case records where a malformed descriptive field leaves only the identifiers.

    Only an invalid id still rejects the record (``errors`` not empty). The digest of such a
    record covers its raw text, so any edit still shows.
    """
    # JSON objects print their keys in order, so the text does not depend on the source's order.
    full = normalize_cases(raw.withColumn("raw_digest", F.sha2(F.to_json(F.col("record")), 256)))
    broken = F.size("errors") > 0
    kept = {"external_id", "process_number", "folder", "customer_ids"}
    fields = list(_case_fields())
    digest = F.when(broken, F.col("raw_digest")).otherwise(s.row_digest(*fields))
    id_error = F.when(F.col("external_id").isNull(), F.lit("id_invalid"))
    others = [c for c in full.columns if c not in {*fields, "raw_digest", "errors"}]
    return full.select(
        *others,
        *[F.col(f) if f in kept else F.when(~broken, F.col(f)).alias(f) for f in fields],
        broken.alias("identifiers_only"),
        digest.alias("record_digest"),
        s.codes(id_error).alias("errors"),
    )


def ingest_counters(pages: DataFrame, normalized: DataFrame, key: str) -> DataFrame:
    """One row: pages, reported total, accepted, rejected and duplicates of one resource.

    Duplicates count as rejected, and both numbers come from per-key counts.
    """
    from folioscope.sources.pages import check_pages

    clean = F.size("errors") == 0
    per_key = normalized.filter(clean).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    sums = per_key.agg(
        F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )
    broken = normalized.agg(F.count_if(~clean).alias("n")).scalar()
    reported = check_pages(pages).agg(F.count(F.lit(1)).alias("pages"), F.max("total").alias("total_reported"))
    return (
        reported.withColumn("accepted", sums.select("accepted").scalar())
        .withColumn("duplicates", sums.select("duplicates").scalar())
        .withColumn("rejected", broken + F.col("duplicates"))
        .withColumn("balanced", F.col("accepted") + F.col("rejected") == F.col("total_reported"))
    )


def candidate_coverage(records: DataFrame, salt: str, with_customers: bool) -> DataFrame:
    """One row of counts over raw records: ids, origins, folders and responsible persons.

    Origins are compared as salted digests only.
    """
    from folioscope.operators.profile import with_direct_partner

    opened = _opened(
        with_direct_partner(records.withColumn("_json", F.to_json(F.col("record"))), "_json").drop("_json"),
        ("id", "origin", "folder", "responsible_id"),
        related=with_customers,
    )

    def digest(value: s.Raw) -> Column:
        return s.opaque_digest(s.text_or_null(value), salt)

    if with_customers:
        digests = F.array_distinct(F.array_compact(F.transform("_related", lambda r: digest(s.entry_value(r, "origin")))))
        digests = F.coalesce(digests, F.array().cast("array<string>"))
    else:
        digests = s.codes(digest(_get("origin")))
    rows = opened.select(
        s.technical_id(_get("id")).alias("_id"),
        digests.alias("_origins"),
        (s.edge_trim(s.text_or_null(_get("folder"))) != "").alias("_folder"),
        s.technical_id(_get("responsible_id")).isNotNull().alias("_responsible"),
        F.col("direct").alias("_direct"),
    )
    origins = F.size("_origins")
    distinct_origins = (
        rows.select(F.explode("_origins").alias("o")).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    return (
        rows.groupBy("_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if("_direct").alias("_direct"),
            F.count_if(origins > 0).alias("_with"),
            F.count_if("_folder").alias("_folder"),
            F.count_if("_responsible").alias("_responsible"),
            F.count_if(origins == 1).alias("_one"),
            F.count_if(origins > 1).alias("_many"),
        )
        .agg(
            F.sum("_n").alias("total"),
            F.sum(F.col("_n") - 1).alias("duplicate_ids"),
            F.sum("_direct").alias("direct_partner_fields"),
            F.sum("_with").alias("with_origin"),
            F.sum(F.col("_n") - F.col("_with")).alias("without_origin"),
            F.sum("_folder").alias("with_folder"),
            F.sum("_responsible").alias("with_responsible"),
            F.sum("_one").alias("one_origin"),
            F.sum("_many").alias("many_origins"),
        )
        .withColumn("distinct_origins", distinct_origins)
    )


def missing_relationships(case_records: DataFrame, customer_records: DataFrame) -> DataFrame:
    """One row: customer references in case records, and distinct referenced ids without a record."""
    # Entries become rows before they are opened, and only their id is.
    entries = F.explode(F.try_variant_get(F.col("record"), f"$.{RELATED}", "array<variant>"))
    refs = (
        s.open_record(case_records.select(entries.alias("entry")), ["customer_id"], "entry")
        .select(s.technical_id(_get("customer_id")).alias("_id"))
        .filter("_id is not null")
    )
    per_id = refs.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    known = _opened(customer_records, ("id",)).select(s.technical_id(_get("id")).alias("_id")).distinct()
    # References are counted once, with a mark of those that have a record.
    marked = per_id.join(known.withColumn("_known", F.lit(True)), "_id", "left")
    return marked.agg(F.sum("_n").alias("customer_references"), F.count_if(F.col("_known").isNull()).alias("missing_customers"))
