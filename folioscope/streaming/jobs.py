"""Structured Streaming forms of the incremental jobs. Each gives the result of its batch twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.operators.spread import first_rows
from folioscope.streaming.keyed_log import KeyedLog, Ledger

MOVEMENT_KEYS = ("case_id", "fingerprint")


def _table(like: DataFrame, path: str) -> None:
    """Creates the folder of a table, so that the first batch finds it."""
    like.sparkSession.createDataFrame([], like.schema).write.mode("append").partitionBy(*PARTS).parquet(path)


#: Stored rows lie by day, and within a day by batch, so that a batch reads the days that it has itself.
PARTS = ("day", "batch")


def stream_movements(
    stream: DataFrame, cases: DataFrame, target: str, errors: str, checkpoint: str
) -> StreamingQuery:
    """Appends new movements by (case, fingerprint); movements of unknown cases go to ``errors``.

    Copies within a batch are dropped there; a copy in a later batch is caught by an anti-join with the
    stored rows of its day, since a fingerprint covers the instant. So no state is kept and nothing is
    too late, however old it is. Each batch owns its folders, so a repeated batch replaces itself.
    """
    known = cases.select("case_id").distinct()
    schema = stream.select("*", F.to_date("occurred_at").alias("day"), F.lit(0).cast("bigint").alias("batch")).schema
    spark = stream.sparkSession
    for folder in (target, errors):
        _table(spark.createDataFrame([], schema), folder)

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        numbered = batch.dropDuplicates(list(MOVEMENT_KEYS)).withColumns({"day": F.to_date("occurred_at"), "batch": F.lit(batch_id).cast("bigint")})
        days = [r["day"] for r in numbered.select("day").distinct().collect()]
        of_days = F.col("day").isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col("day").isNull())

        def unseen(rows: DataFrame, folder: str) -> DataFrame:
            stored = session.read.schema(schema).parquet(folder).filter(of_days & (F.col("batch") < batch_id))
            keys = stored.select(*[F.col(k).alias(f"_{k}") for k in MOVEMENT_KEYS])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in MOVEMENT_KEYS]
            return rows.join(keys, same, "left_anti")

        _write_batch(unseen(numbered.join(known, "case_id", "left_semi"), target), target, PARTS)
        lost = numbered.filter("case_id is not null").join(known, "case_id", "left_anti")
        _write_batch(unseen(lost, errors), errors, PARTS)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_batch(rows: DataFrame, target: str, parts: tuple[str, ...] = ("batch",)) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(target)
    )


def _log(spark: SparkSession, target: str, schema: StructType, key: str, batch: int | None) -> tuple[Ledger, KeyedLog]:
    """The log under ``target`` as of a batch, or of the last one."""
    ledger = Ledger(spark, target)
    if batch is None:
        ledger.load_last()
    else:
        ledger.load(batch)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return ledger, KeyedLog(ledger, target, "rows", names, key)


def current_state(spark: SparkSession, target: str, schema: StructType, key: str) -> DataFrame:
    """The newest row per key that a stream has logged under ``target``, with the ``action`` that wrote it."""
    return _log(spark, target, schema, key, None)[1].newest().drop("batch")


def stream_upsert(
    stream: DataFrame, key: str, hash_col: str, order_col: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Logs inserted and changed rows per micro-batch under ``target``, in buckets of the key.

    Only changed rows are written, never the whole state; :func:`current_state` reads the newest row per key. A batch
    looks its keys up in their buckets, which are merged now and then, so what it reads doesn't grow with the log.
    """
    schema = stream.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        ledger, log = _log(batch.sparkSession, target, schema, key, batch_id - 1)
        newest = first_rows(batch, [key], [F.col(order_col).desc(), F.col(hash_col).desc()])
        known = log.state_of(newest, key).select(key, F.col(hash_col).alias("_stored"))
        action = F.when(F.col("_stored").isNull(), "insert").when(F.col("_stored") != F.col(hash_col), "update")
        log.log(newest.join(known, key, "left").withColumn("action", action).filter("action is not null"), batch_id)
        ledger.commit(batch_id)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_latest(stream: DataFrame, cases: DataFrame, as_of: dt.datetime | str | None = None) -> DataFrame:
    """Latest movement per known case, kept up to date (update or complete mode)."""
    seen = stream if as_of is None else stream.filter(F.col("occurred_at") <= F.lit(str(as_of)).cast("timestamp"))
    seen = seen.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    best = F.max(F.struct("occurred_at", (-F.col("movement_id")).alias("_minus_id"), "title"))
    return seen.groupBy("case_id").agg(best.alias("_best")).select(
        "case_id",
        F.col("_best.occurred_at").alias("last_movement_at"),
        F.col("_best.title").alias("last_movement_title"),
    )


def stream_audit_counts(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Audit events per action and day; a day is final once the watermark has passed it."""
    day = F.window("occurred_at", "1 day")
    return (
        stream.withWatermark("occurred_at", watermark)
        .groupBy(day.alias("day"), "action")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("day.start").alias("day"), "action", "events")
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Drains an append-mode stream into a parquet folder."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keep_latest_in_table(latest: DataFrame, key: str, target: str, checkpoint: str) -> None:
    """Drains an update-mode stream; every batch logs the keys it changed, for :func:`current_state`."""
    schema = latest.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger, log = _log(batch.sparkSession, target, schema, key, batch_id - 1)
        log.log(batch.withColumn("action", F.lit("update")), batch_id)
        ledger.commit(batch_id)

    query = (
        latest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
