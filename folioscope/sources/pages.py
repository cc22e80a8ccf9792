"""Landed collection pages: reading, page contract and scan completeness.

A landed page is one JSON document per line, ``{data[], totalCount, limit, offset}``, next to the
offset and limit that were asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scalars import field, is_object, open_record, opened, positive_id

LANDED_SCHEMA = "resource string, requested_offset bigint, requested_limit bigint, payload string"


def read_pages(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """Pages of one resource from a folder of landed JSON lines."""
    landed = spark.read.schema(LANDED_SCHEMA).json(path)
    return parse_pages(landed.filter(F.col("resource") == resource))


def parse_pages(landed: DataFrame) -> DataFrame:
    """Adds the parsed envelope as a VARIANT; text that is no JSON gives a null page."""
    return landed.withColumn("page", F.try_parse_json("payload")).drop("payload")


def _records() -> Column:
    return F.try_variant_get(field("page", "data"), "$", "array<variant>")


def page_records(pages: DataFrame) -> DataFrame:
    """One row per record with its page offset and position; contract violations are not checked."""
    return pages.select("requested_offset", F.posexplode(_records()).alias("position", "record"))


def check_pages(pages: DataFrame) -> DataFrame:
    """(requested_offset, row_count, total, violation) per page; the first violated rule is named."""
    def integer(name: str) -> Column:
        return opened(name).integer()

    measured = (
        open_record(
            pages.select("requested_offset", "requested_limit", "page", _records().alias("_list")),
            ("totalCount", "offset", "limit"),
            "page",
            [
                is_object(F.col("page")).alias("_object"),
                F.size("_list").alias("_size"),
                F.coalesce(F.exists("_list", lambda r: ~is_object(r)), F.lit(False)).alias("_foreign"),
            ],
        )
        .drop("_list")
        .withColumn("row_count", F.coalesce(F.nullif("_size", F.lit(-1)), F.lit(0)).cast("bigint"))
        .withColumn("total", integer("totalCount"))
    )
    end = F.col("requested_offset") + F.col("row_count")
    violation = (
        F.when(~F.coalesce("_object", F.lit(False)), "not_an_object")
        .when(F.col("_size").isNull() | (F.col("_size") < 0) | F.col("total").isNull(), "envelope_invalid")
        .when((F.col("total") < 0) | (F.col("row_count") > F.col("requested_limit")), "size_invalid")
        .when(F.col("_foreign"), "record_invalid")
        .when(
            ~integer("offset").eqNullSafe(F.col("requested_offset"))
            | ~integer("limit").eqNullSafe(F.col("requested_limit")),
            "echo_mismatch",
        )
        .when((F.col("requested_offset") < F.col("total")) & (F.col("row_count") == 0), "empty_page")
        .when(end > F.col("total"), "overrun")
    )
    return measured.select("requested_offset", "row_count", "total", violation.alias("violation"))


def check_scan(pages: DataFrame, id_name: str = "id") -> DataFrame:
    """One row about a whole scan: constant total, no gaps, unique ids.

    Every page end but the total must be the start of another page; starts and ends are counted
    against each other per offset, so no window runs over all pages.
    """
    checked = check_pages(pages)
    edges = checked.select(
        "total",
        F.explode(
            F.array(
                F.struct(F.col("requested_offset").alias("at"), F.lit(1).alias("side")),
                F.struct((F.col("requested_offset") + F.col("row_count")).alias("at"), F.lit(-1).alias("side")),
            )
        ).alias("e"),
    )
    gaps = edges.groupBy("e.at").agg(F.sum("e.side").alias("_open"), F.max("total").alias("_total")).filter(
        (F.col("_open") < 0) & (F.col("at") != F.col("_total"))
    )
    ids = open_record(page_records(pages).drop("position"), [id_name]).select(
        "requested_offset", positive_id(opened(id_name)).alias("_id")
    )
    per_page = ids.filter("_id is not null").groupBy("_id", "requested_offset").agg(F.count(F.lit(1)).alias("_n"))
    per_id = per_page.groupBy("_id").agg(F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_pages"))
    repeats = per_id.agg(
        F.count_if(F.col("_most") > 1).alias("in_page"), F.count_if(F.col("_pages") > 1).alias("across_pages")
    )
    summary = checked.agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("records"),
        F.max("total").alias("total"),
        (F.coalesce(F.min("total") == F.max("total"), F.lit(False))).alias("total_constant"),
        F.count("violation").alias("page_violations"),
        F.min("requested_offset").alias("_start"),
    )
    return (
        summary.withColumn("gaps", gaps.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("repeated_in_page", repeats.select("in_page").scalar())
        .withColumn("repeated_across_pages", repeats.select("across_pages").scalar())
        .withColumn(
            "complete",
            F.col("total_constant")
            & (F.col("_start") == 0)
            & (F.col("gaps") == 0)
            & (F.col("records") == F.col("total"))
            & (F.col("page_violations") == 0)
            & (F.col("repeated_in_page") == 0)
            & (F.col("repeated_across_pages") == 0),
        )
        .drop("_start")
    )
