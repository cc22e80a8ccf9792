"""Snapshots under a hash tree: two reads are compared by digests, and read again only where they differ.

A row lies in a range by the leading bits of its key's hash. The digest of a range is that of ``spread``: sums
of the words of row hashes, so the digest of a wider range is the sum of those of its parts, and every level of
the tree is an aggregate of the level below. Rows are stored in folders by range; a comparison goes down from the
root, ``FAN_BITS`` at a time, into differing nodes only, and opens the folders of differing ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.spread import DIGEST_WORDS, dealt, digest_words, finished_digest

FAN_BITS = 4
#: Rows of a range, about, and the most bits that tell ranges apart (so many folders has a snapshot at most).
RANGE_ROWS = 1 << 18
MOST_BITS = 16


def range_of(key: Sequence[str], bits: int) -> Column:
    """The leading bits of the key's hash, as a number from 0."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits) if bits else F.lit(0).cast("bigint")


def bits_for(rows: int) -> int:
    """Bits, a multiple of ``FAN_BITS``, that leave about ``RANGE_ROWS`` rows in a range."""
    bits = FAN_BITS
    while bits < MOST_BITS and rows >> bits > RANGE_ROWS:
        bits += FAN_BITS
    return bits


def write_snapshot(df: DataFrame, key: Sequence[str], folder: str, bits: int = 2 * FAN_BITS) -> None:
    """Stores the rows of a read by range, and the digests of all levels of the tree over them.

    ``bits`` is a multiple of ``FAN_BITS``, the same for all snapshots that are compared; ``bits_for`` gives one.
    """
    if bits % FAN_BITS or not 0 < bits <= MOST_BITS:
        raise ValueError(f"bits must be a multiple of {FAN_BITS}, up to {MOST_BITS}")
    placed = df.withColumn("_range", range_of(key, bits))
    # Rows of a range meet in few files, and a big range is dealt to several tasks by its size.
    placed.hint("rebalance", "_range").write.partitionBy("_range").parquet(f"{folder}/rows")
    schema = placed.schema
    written = df.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    leaves = digest_words(written.withColumn("node", F.col("_range")), df.columns, ["node"])
    tree, spark = f"{folder}/tree", df.sparkSession
    leaves.write.parquet(f"{tree}/level={bits}")
    for level in range(bits - FAN_BITS, -1, -FAN_BITS):
        below = _level(spark, folder, level + FAN_BITS)
        sums = [F.sum(c).cast(below.schema[c].dataType).alias(c) for c in ("rows", *DIGEST_WORDS)]
        below.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*sums).write.parquet(f"{tree}/level={level}")


_NODE = "node bigint, rows bigint, " + ", ".join(f"{w} decimal(38,0)" for w in DIGEST_WORDS)


def _level(spark: SparkSession, folder: str, level: int) -> DataFrame:
    return spark.read.schema(_NODE).parquet(f"{folder}/tree/level={level}")


def root_digest(spark: SparkSession, folder: str) -> DataFrame:
    """One row: rows and digest of a whole snapshot, as ``spread.multiset_digest`` gives them."""
    return finished_digest(_level(spark, folder, 0).drop("node"))


def differing_ranges(spark: SparkSession, first: str, second: str, bits: int = 2 * FAN_BITS) -> list[int]:
    """The ranges in which two snapshots differ; at most 2 to the ``bits``, found level by level."""
    nodes = [0]
    for level in range(0, bits + 1, FAN_BITS):
        here = F.shiftright("node", FAN_BITS) if level else F.col("node")
        one, two = (_level(spark, f, level).filter(here.isin(nodes)) for f in (first, second))
        both = one.unionByName(two).groupBy("node", "rows", *DIGEST_WORDS).agg(F.count(F.lit(1)).alias("n"))
        nodes = sorted(r["node"] for r in both.filter("n = 1").select("node").distinct().collect())
        if not nodes:
            return []
    return nodes


def differing_keys(spark: SparkSession, first: str, second: str, schema: str, key: Sequence[str], bits: int = 2 * FAN_BITS) -> DataFrame:
    """The keys whose rows differ between two snapshots, with ``difference``: removed, added or changed.

    A key with several rows is compared as the collection of its rows. Null parts of a key are a value like others.
    """
    ranges = differing_ranges(spark, first, second, bits)
    # Eight words of 32 bits of each row's hash, whose sums over the rows of a key are plain longs.
    words = {f"_v{i}": F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)}
    sides = []
    for folder in (first, second):
        rows = spark.read.schema(f"{schema}, _range bigint").parquet(f"{folder}/rows").filter(F.col("_range").isin(ranges))
        columns = [c for c in rows.columns if c != "_range"]
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
        hashed = rows.select(*key, F.sha2(text, 256).alias("_h")).select(*key, *[w.alias(n) for n, w in words.items()])
        # Spark may join the sides by their partitions, and then would merge these into few tasks: their number is named.
        sides.append(dealt(hashed, *key).withColumn("_n", F.lit(1).cast("bigint")))
    # What the second side has is subtracted, so both sides meet in one aggregate and equal rows leave nothing.
    counted = [*words, "_n"]
    taken = sides[1].select(*key, *[(-F.col(n)).alias(n) for n in counted], F.lit(1).alias("_side"))
    both = sides[0].withColumn("_side", F.lit(0)).unionByName(taken)
    sums = both.groupBy(*key).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"), *[F.sum(n).alias(n) for n in counted])
    differs = reduce(lambda a, b: a | b, (F.col(n) != 0 for n in counted))
    kind = F.when(F.col("_low") == 1, "added").when(F.col("_high") == 0, "removed").otherwise("changed")
    return sums.filter(differs).select(*key, kind.alias("difference"))


def moved_digest(words: DataFrame, removed: DataFrame, added: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``digest_words`` of a table after rows left and came, from those rows alone.

    ``words`` is that of the table before. Digests are sums, so what leaves is subtracted and what comes is added;
    the rest of the table isn't read. A changed row leaves as it was and comes as it is. Groups without rows go.
    """
    signed = digest_words(added, columns, by).unionByName(
        digest_words(removed, columns, by).select(*by, *[(-F.col(c)).alias(c) for c in ("rows", *DIGEST_WORDS)])
    )
    sums = [F.sum(c).cast(words.schema[c].dataType).alias(c) for c in ("rows", *DIGEST_WORDS)]
    return words.unionByName(signed).groupBy(*by).agg(*sums).filter("rows <> 0")

