"""Any page of a long sorted list by reading one range of it.

The list is sorted once into ranges of its sort key, which are folders, and the rows of each range are counted. The
counts tell which range holds a page, so page 1,000,000 costs what page 1 costs; no task holds the rows before it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about: what a task sorts to cut out a page.
RANGE_ROWS = 1 << 16
_COUNTS = "_range int, n bigint"


def write_index(df: DataFrame, order: Sequence[Column], folder: str, range_rows: int = RANGE_ROWS) -> None:
    """Stores the rows under ``folder`` by ranges of ``order``, which must tell all rows apart, and their counts.

    Ranges come from a sample, so their sizes vary; their counts are exact. Rows that are equal in ``order`` share a
    range, in no defined order.
    """
    ranges = -(-df.count() // range_rows) or 1
    placed = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    placed.write.partitionBy("_range").parquet(f"{folder}/rows")
    spark = df.sparkSession
    written = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    written.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.json(f"{folder}/counts")
    schema = spark.createDataFrame([(json.dumps(df.schema.jsonValue()),)], "schema string")
    schema.coalesce(1).write.text(f"{folder}/schema")


def read_page(spark: SparkSession, folder: str, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The rows of a page with ``page``, ``pages`` and ``total_rows``; a number outside means the nearest page."""
    counts = {r["_range"]: r["n"] for r in spark.read.schema(_COUNTS).json(f"{folder}/counts").collect()}
    total = sum(counts.values())
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    first, last = (number - 1) * size, min(number * size, total)
    before, at = {}, 0
    for r in sorted(counts):
        if at < last and at + counts[r] > first:
            before[r] = at
        at += counts[r]
    text = spark.read.text(f"{folder}/schema").first()[0]
    schema = T.StructType.fromJson(json.loads(text))
    rows = spark.read.schema(schema.add("_range", T.IntegerType())).parquet(f"{folder}/rows").filter(F.col("_range").isin(list(before)))
    start = F.lit(0).cast("bigint")
    for r, n in before.items():
        start = F.when(F.col("_range") == r, n).otherwise(start)
    # The window holds the rows of one range.
    place = start + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    shown = rows.withColumn("_place", place).filter((F.col("_place") > first) & (F.col("_place") <= last))
    return shown.drop("_range", "_place").withColumns({"page": F.lit(number), "pages": F.lit(pages), "total_rows": F.lit(total)})
