"""Tables as logs of changed rows in buckets of their key, read through a ledger of commits.

A batch writes what it changes as one segment per table, in folders by bucket. Its last step is the
ledger entry that names the live segments of every bucket of every table: until then none of it is seen,
and a repeated batch writes the same folders again. So a batch counts wholly or not at all, over all
tables. A bucket with ``MOST_SEGMENTS`` segments is merged into one in the batch that fills it; a lookup
therefore reads the buckets of its keys, each at most as often as that, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.spread import first_rows

BUCKETS = 16
MOST_SEGMENTS = 4

_ENTRY = "name string, bucket int, segments array<string>"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(*keys: tuple[DataFrame, str], buckets: int = BUCKETS) -> list[list[int]]:
    """For each of the key columns, the buckets in which its keys lie, in one job; null keys lie in none."""
    parts = [
        rows.filter(F.col(key).isNotNull()).select(F.lit(i).alias("i"), bucket_of(key, buckets).alias("b"))
        for i, (rows, key) in enumerate(keys)
    ]
    found = [set() for _ in keys]
    for row in reduce(DataFrame.unionByName, parts).distinct().collect():
        found[row["i"]].add(row["b"])
    return [sorted(f) for f in found]


class Ledger:
    """The live segments after a batch, per table and bucket."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self.live: dict[tuple[str, int], list[str]] = {}

    def _path(self, batch: int) -> str:
        return f"{self._folder}/ledger/batch={batch}"

    def load(self, batch: int) -> bool:
        """Takes over the entry of a batch; False if that batch wasn't committed."""
        try:
            rows = self._spark.read.schema(_ENTRY).json(self._path(batch)).collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False
        self.live = {(r["name"], r["bucket"]): list(r["segments"]) for r in rows}
        return bool(rows)

    def load_last(self) -> bool:
        """Takes over the newest entry; False if there is none."""
        try:
            entries = self._spark.read.schema(f"{_ENTRY}, batch bigint").json(f"{self._folder}/ledger")
            last = entries.agg(F.max("batch").alias("last")).first()["last"]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False
        return last is not None and self.load(last)

    def commit(self, batch: int) -> None:
        rows = [(name, bucket, segments) for (name, bucket), segments in sorted(self.live.items())]
        # A bucket below all others, so that a batch without any rows is an entry too.
        frame = self._spark.createDataFrame([("", -1, []), *rows], _ENTRY)
        frame.coalesce(1).write.mode("overwrite").json(self._path(batch))


class KeyedLog:
    """One table: rows by ``key``; the newest of equal ``identity`` counts, unless it is a deletion.

    A batch has one row per identity, but where it ``repeats`` them.
    """

    def __init__(
        self,
        ledger: Ledger,
        folder: str,
        name: str,
        schema: str,
        key: str,
        identity: Sequence[str] | None = None,
        buckets: int = BUCKETS,
        repeats: bool = False,
    ):
        self._ledger, self._folder, self.name = ledger, folder, name
        self.key, self.identity, self._buckets = key, list(identity or [key]), buckets
        self._repeats = repeats
        self.columns = [f.name for f in T._parse_datatype_string(schema).fields]
        self._schema = f"{schema}, action string, batch bigint"

    def _spark(self) -> SparkSession:
        return self._ledger._spark

    def changes(self, batch: int) -> DataFrame:
        """What a batch changed, with its ``action``, whatever was merged since."""
        return self.segment(f"segment={batch}")

    def segment(self, segment: str, schema: str | None = None) -> DataFrame:
        return self._spark().read.schema(schema or self._schema).option("recursiveFileLookup", "true").parquet(f"{self._folder}/{self.name}/{segment}")

    def paths(self, buckets: Sequence[int] | None = None) -> list[str]:
        """The live folders of the buckets, or of all."""
        wanted = None if buckets is None else set(buckets)
        return [
            f"{self._folder}/{self.name}/{segment}/bucket={b}"
            for (name, b), segments in sorted(self._ledger.live.items())
            if name == self.name and (wanted is None or b in wanted)
            for segment in segments
        ]

    def newest(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest rows of the buckets, or of the whole table, with the ``action`` and ``batch`` that wrote them."""
        wanted = None if buckets is None else set(buckets)
        alone: dict[str, list[int]] = {}
        layered: dict[str, list[int]] = {}
        for (name, b), segments in self._ledger.live.items():
            if name == self.name and (wanted is None or b in wanted):
                for segment in segments:
                    (layered if self._repeats or len(segments) > 1 else alone).setdefault(segment, []).append(b)
        # One scan per segment; the filter on its folders leaves other buckets unread.
        parts = [self._of_buckets(segment, some) for segment, some in alone.items()]
        if layered:
            logged = reduce(DataFrame.unionByName, [self._of_buckets(segment, some) for segment, some in layered.items()])
            parts.append(first_rows(logged, self.identity, [F.col("batch").desc()]))
        if not parts:
            return self._spark().createDataFrame([], self._schema)
        return reduce(DataFrame.unionByName, parts).filter("action <> 'delete'")

    def _of_buckets(self, segment: str, buckets: list[int]) -> DataFrame:
        rows = self._spark().read.schema(f"{self._schema}, bucket int").parquet(f"{self._folder}/{self.name}/{segment}")
        return rows.filter(F.col("bucket").isin(buckets)).drop("bucket")

    def state(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows of the buckets, or of the whole table."""
        return self.newest(buckets).select(*self.columns)

    def state_of(self, keys: DataFrame, key: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows whose key occurs in ``keys``; only ``buckets``, those of the keys, are read."""
        wanted = keys.select(F.col(key).alias(self.key)).distinct()
        if buckets is None:
            (buckets,) = buckets_of((wanted, self.key), buckets=self._buckets)
        return self.state(buckets).join(wanted, self.key, "left_semi")

    def _write(self, rows: DataFrame, segment: str, also: Sequence[str] = ()) -> list[int]:
        """Writes a segment and returns the buckets that it has."""
        path = f"{self._folder}/{self.name}/{segment}"
        placed = rows.select(*self.columns, *also, "action", "batch", bucket_of(self.key, self._buckets).alias("bucket"))
        # A salt by identity, so that a bucket that holds one very frequent key has several writers; adaptive
        # execution gives a large segment more of them.
        spread = F.pmod(F.xxhash64(*self.identity), F.lit(4))
        placed = placed.withColumn("_spread", spread).hint("rebalance", F.col("bucket"), F.col("_spread")).drop("_spread")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return sorted({int(f.split("/bucket=")[1].split("/")[0]) for f in self.segment(segment).inputFiles()})

    def log(self, changed: DataFrame, batch: int, also: str = "") -> DataFrame:
        """Writes a batch's changed rows, with their ``action``, and returns them as written.

        ``also`` declares columns that are written with them but don't belong to the table.
        """
        more = T._parse_datatype_string(also) if also else T.StructType([])
        segment = f"segment={batch}"
        numbered = changed.withColumn("batch", F.lit(batch).cast("bigint"))
        written = self._write(numbered, segment, more.names)
        for b in written:
            self._ledger.live.setdefault((self.name, b), []).append(segment)
        full = [b for (name, b), segments in self._ledger.live.items() if name == self.name and len(segments) >= MOST_SEGMENTS]
        if full:
            merged = f"merged={batch}"
            left = set(self._write(self.newest(full), merged))
            for b in full:
                if b in left:
                    self._ledger.live[self.name, b] = [merged]
                else:
                    del self._ledger.live[self.name, b]
        schema = f"{self._schema}, {also}" if also else self._schema
        return self.segment(segment, schema) if written else self._spark().createDataFrame([], schema)
