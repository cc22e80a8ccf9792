"""Building blocks that stay safe when one key holds a large share of all rows.

The rules behind them: aggregate before the shuffle, join back instead of opening a window
over a whole group, give null keys a key of their own, and number rows through bounded slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import work_folder

# A 63-bit id is read as three 21-bit digits, so no window ever holds more than 2**21 unique ids.
_DIGIT = 21


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as ``spark.sql.shuffle.partitions`` says.

    Adaptive execution merges partitions by their packed size, down to a task per core: columns that pack
    well then give a task many millions of rows to sort or to keep. A number that is named stays.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key (null keys left out), combined on the map side."""
    usable = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.filter(usable).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def repeated_keys(df: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    """One row per key that occurs more than once."""
    return group_sizes(df, keys, name).filter(F.col(name) > 1)


def own_key(key: Column, row_id: Column) -> Column:
    """The key as text; a null key becomes unique per row, so nulls never meet in one task."""
    return F.when(key.isNotNull(), F.concat(F.lit("k"), key.cast("string"))).otherwise(
        F.concat(F.lit("r"), row_id.cast("string"))
    )


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark keeps only ``n`` rows per group and task before the shuffle (window group limit), so
    the size of a group does not matter.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def id_digits(id_col: str) -> list[Column]:
    """Order-preserving high and middle digits of a non-negative bigint id."""
    high = F.shiftright(F.col(id_col), 2 * _DIGIT)
    middle = F.shiftright(F.col(id_col), _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1))
    return [high, middle]


def positions(
    df: DataFrame,
    by: Sequence[str],
    id_col: str,
    name: str,
    before_id: Sequence[tuple[str, ...]] = (),
    id_levels: int = 2,
) -> DataFrame:
    """1-based position of each row in its ``by`` group, ordered by ``before_id`` then ``id_col``.

    ``id_col`` is a unique non-negative bigint inside the group. ``before_id`` lists columns of
    bounded cardinality (a day, a kind); each tuple is one level of the order. The group is cut
    into slices along the levels and the digits of the id; slice sizes are summed level by level
    and only a slice is sorted in one task. Where the levels alone leave small groups, fewer
    ``id_levels`` save shuffles.

    The rows are written to the shared work folder first, so they are computed once. Where no group is
    larger than a slice may be, as the written keys tell, the numbers come from one window.
    """
    folder = work_folder(df.sparkSession, "positions")
    df.write.parquet(folder)
    df = df.sparkSession.read.schema(df.schema).parquet(folder)
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    if largest <= 1 << _DIGIT:
        order = [c for level in before_id for c in level]
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order, id_col)).cast("bigint"))
    slices = id_digits(id_col) if id_levels == 2 else [F.shiftright(F.col(id_col), _DIGIT)]
    digits = {f"_d{i}": c for i, c in enumerate(slices)}
    sliced = df.withColumns(digits)
    levels = [tuple(level) for level in before_id] + [(d,) for d in digits]
    slice_keys = [c for level in levels for c in level]

    sizes = sliced.groupBy(*by, *slice_keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.lit(0).cast("bigint")).drop("_n")
    prefix = list(by)
    for level in levels:
        keys = prefix + list(level)
        w = Window.partitionBy(*prefix).orderBy(*level)
        step = (
            sizes.groupBy(*keys)
            .agg(F.sum("_n").alias("_n"))
            .withColumn("_shift", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
            .drop("_n")
        )
        offsets = (
            join_null_safe(offsets, step, keys)
            .withColumn("_before", F.col("_before") + F.col("_shift"))
            .drop("_shift")
        )
        prefix = keys
    inner = F.row_number().over(Window.partitionBy(*prefix).orderBy(id_col))
    return (
        join_null_safe(sliced.withColumn("_in", inner), offsets, prefix)
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_before", "_in", *digits)
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null equals null; the keys of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


#: Columns that hold the sums of the four 64-bit words of row hashes.
DIGEST_WORDS = ("_w0", "_w1", "_w2", "_w3")


def digest_words(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` and the sums of row hashes per group: the state of ``multiset_digest``, which can be added and subtracted."""
    text = F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    )
    hashed = df.withColumn("_h", F.sha2(text, 256)).withColumns(
        {
            w: F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
            for i, w in enumerate(DIGEST_WORDS)
        }
    )
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").alias(w) for w in DIGEST_WORDS]
    total = F.count(F.lit(1)).alias("rows")
    return hashed.groupBy(*by).agg(total, *sums) if by else hashed.agg(total, *sums)


def finished_digest(words: DataFrame, name: str = "digest") -> DataFrame:
    """The digest in place of the sums of ``digest_words``."""
    parts = [F.col("rows").cast("string"), *[F.col(w).cast("string") for w in DIGEST_WORDS]]
    return words.withColumn(name, F.sha2(F.concat_ws(":", *parts), 256)).drop(*DIGEST_WORDS)


def multiset_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "digest") -> DataFrame:
    """Order-independent digest of the rows of each group.

    Every row is hashed on its own; the four 64-bit words of the hashes are summed, which keeps a
    constant state per group, merges on the map side and changes with any row or copy of a row.
    """
    return finished_digest(digest_words(df, columns, by), name).select(*by, "rows", name)


def only_value(df: DataFrame, column: str) -> Column:
    """The value of a one-row aggregate as a scalar subquery (no cross join)."""
    return df.select(column).scalar()
