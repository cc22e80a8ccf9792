"""Steps that several operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two longs that tell documents apart. Rows equal in id and text count as one document.
KEY = ["_id", "_h"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the key of each row; other columns go, so their names can't clash."""
    return df.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("_h"),
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
    )


def whole(df: DataFrame) -> Column:
    """All columns of a row as one, so that whatever their names are they can't clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def keyed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each row, and the row in the column ``row``."""
    return df.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("_h"),
        whole(df).alias("row"),
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the one that ``spark.checkpoint.dir`` names.

    Only where the setting is missing, as in tests, the warehouse takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever executors are lost."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is.

    ``lower`` does the same wherever nothing but ASCII and the small letters of Latin-1 occurs; the
    slower character map is left for the other texts.
    """
    plain = ~text.rlike(r"[^\x00-\x7F\xDF-\xFF]")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
