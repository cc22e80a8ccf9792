"""Sinks: count-only summaries and versioned report slices."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_KEYS = ("partner_id", "period_end", "version")


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object from a one-row frame of counts.

    Only whole numbers, booleans and maps of them may leave; a text column is refused.
    """
    allowed = ("bigint", "int", "boolean", "map<string,bigint>", "map<string,int>")
    refused = [f.name for f in summary.schema.fields if f.dataType.simpleString() not in allowed]
    if refused:
        raise ValueError(f"not a count: {refused}")
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).write.mode("errorifexists").text(path)


class SliceConflict(RuntimeError):
    """Another writer has committed one of the same slices meanwhile."""


def write_report_version(report: DataFrame, path: str, version: int, on_conflict: str = "replace") -> int:
    """Writes the (partner, period) slices of one version and returns the number of its commit.

    A later commit of a slice of the same version takes its place, other slices stay. With ``on_conflict="fail"`` a
    write raises :class:`SliceConflict` when one of its slices was committed by someone else since it began.
    """
    base = last_commit(report.sparkSession, path)
    return commit_slices(report.sparkSession, path, stage_slices(report, path, version), base, on_conflict)


def stage_slices(report: DataFrame, path: str, version: int) -> str:
    """Writes slices and their index rows under a name of their own; nobody sees them before their commit.

    The index rows are counted from what was written, so the report is computed once.
    """
    write_id = f"w{uuid.uuid4().hex}"
    folder = f"{path}/slices/write_id={write_id}"
    slices = report.withColumn("version", F.lit(version).cast("bigint"))
    # Rows of one slice meet in few files, and a big slice is dealt to several tasks by its size.
    slices.hint("rebalance", *SLICE_KEYS[:2]).write.partitionBy(*SLICE_KEYS).parquet(folder)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema.fields)
    written = report.sparkSession.read.schema(typed).parquet(folder)
    counts = written.groupBy(*SLICE_KEYS).agg(F.count(F.lit(1)).alias("rows"))
    counts.write.parquet(f"{path}/index/write_id={write_id}")
    return write_id


def commit_slices(spark: SparkSession, path: str, write_id: str, base: int, on_conflict: str = "replace") -> int:
    """Takes the first free number above ``base``; numbers, not clocks, order the commits.

    A number is a file that only one writer can put there. Whoever loses it looks at what the winner wrote, and
    tries the next one.
    """
    if on_conflict not in ("replace", "fail"):
        raise ValueError("on_conflict is replace or fail")
    number, seen = base, base
    while True:
        if on_conflict == "fail":
            others = _commits(spark, path).filter((F.col("commit") > seen) & (F.col("write_id") != write_id))
            index = spark.read.schema(_index_schema(spark, path)).parquet(f"{path}/index")
            mine = index.filter(F.col("write_id") == write_id).select(*SLICE_KEYS)
            theirs = index.join(others, "write_id", "left_semi").select(*SLICE_KEYS)
            if not mine.join(theirs, list(SLICE_KEYS), "left_semi").isEmpty():
                raise SliceConflict(f"{path}: a slice of {write_id} was committed after {base}")
        number = max(number, last_commit(spark, path)) + 1
        if _put_if_absent(spark, f"{path}/commits/{number:020}.json", json.dumps({"commit": number, "write_id": write_id})):
            return number
        seen = min(seen, number - 1)


def _put_if_absent(spark: SparkSession, file: str, text: str) -> bool:
    """Puts a small file in place whole, unless there is one; False then."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(file)
    draft = fs.Path(target.getParent().getParent(), f"drafts/{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    store = target.getFileSystem(conf)
    store.mkdirs(target.getParent())
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    # Without the option to overwrite a rename fails where the target exists.
    never_over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, never_over)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        store.delete(draft, False)
        return False
    return True


_COMMIT = "commit bigint, write_id string"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/commits")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _COMMIT)


def last_commit(spark: SparkSession, path: str) -> int:
    """The highest committed number, 0 before the first."""
    return _commits(spark, path).agg(F.max("commit").alias("last")).first()["last"] or 0


def _index_schema(spark: SparkSession, path: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{path}/index").schema.fields}
    return ", ".join(f"{n} {'string' if n == 'write_id' else kind}" for n, kind in types.items())


def _with_types(read: DataFrame, like: DataFrame) -> DataFrame:
    """Partition columns come back with guessed types."""
    return read.select(*[F.col(k).cast(like.schema[k].dataType) if k in SLICE_KEYS else F.col(k) for k in read.columns])


def read_reports(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Rows of committed slices, each from its last commit up to ``as_of``, or up to now.

    The number is fixed when this is called, so one frame shows one snapshot, whoever writes meanwhile.
    """
    number = last_commit(spark, path) if as_of is None else as_of
    index = spark.read.schema(_index_schema(spark, path)).parquet(f"{path}/index")
    seen = index.join(_commits(spark, path).filter(F.col("commit") <= number), "write_id")
    last = seen.groupBy(*SLICE_KEYS).agg(F.max_by("write_id", "commit").alias("write_id"))
    slices = spark.read.parquet(f"{path}/slices").withColumn("write_id", F.col("write_id").cast("string"))
    return _with_types(slices, index).join(last, [*SLICE_KEYS, "write_id"], "left_semi").drop("write_id")
