"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage is one operator of ``folioscope.llm`` over all rows that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, fertility, lines, packing, simhash
from folioscope.llm.common import KEY, keyed, keyed_rows, read, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return fertility.judge(docs).filter("fertility.kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier document has."""
    left = F.when(F.col("lines.n_removed") > 0, F.col("lines.text")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", left)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("lines.n_removed") > 0, F.length(left)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars.cast("bigint"))
    return lines.dedup_lines(docs).select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id (null ids last)."""
    found = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *KEY)).alias("first")
    stay = found.groupBy("root").agg(first).select(*[f"first.{k}" for k in KEY])
    return keyed_rows(docs).join(stay, KEY, "left_semi").dropDuplicates(KEY).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    hit = decontaminate.hit_documents(keyed(docs), read(spark, sf_dir, "benchmark")).select(*KEY)
    return keyed_rows(docs).join(hit, KEY, "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Tokenisers, fingerprints and packing aren't SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
