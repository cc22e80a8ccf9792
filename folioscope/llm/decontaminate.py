"""Benchmark decontamination by a prefix-filtered set join.

Texts become words: runs of digits, letters and whatever isn't ASCII, with A-Z in lower case. An item's
windows are its runs of ``window`` words (a shorter item is one window), and a document is hit wherever
one of them occurs in it. A window is the set of its shingles of ``gram`` words (shorter windows are one
shingle) with their places:

1. One pass over the documents finds every place of every item shingle, word for word.
2. These places give each shingle's frequency, and so the order by rarity. A window with a shingle that
   occurs nowhere can't occur; for the others all shingles are necessary, so the prefix is the rarest.
3. Prefix places are joined to their windows. The offset in the window gives the start (positional
   bound), which must leave room for the whole window in the document (length bound).
4. A candidate is verified by the shingles that tile its window: all of them at their places make up
   the window, word for word.

The item shingles are broadcast only if there are at most ``BROADCAST_GRAMS``; beyond that they are
joined by hash like everything else. All of it is DataFrame expressions.

Null texts have no words. Rows equal in id and text get the same result; so do items of equal text,
each counted under its own item_id (a null one as the empty string), and rows with one item_id are one
item. An empty table on either side gives no hits; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import KEY, ascii_lower, keyed, stored

WINDOW = 10
GRAM = 5
#: At most so many item shingles are sent to every executor, some 100 bytes each.
BROADCAST_GRAMS = 500_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """``item, window, size, k``: the windows of each item and the size of their shingles."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), n - F.col("size") + 1)
    return (
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("words"))
        .filter(n > 0)
        .withColumn("size", F.least(n, F.lit(window)))
        .withColumn("start", F.explode(starts))
        .select("item", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("window"), "size",
                F.least("size", F.lit(gram)).alias("k"))
        .distinct()
    )


def _grams(windows: DataFrame) -> DataFrame:
    """``window, size, k, offset, gram``: the shingles of each window."""
    one = F.slice(F.split("window", " "), F.col("offset") + 1, F.col("k"))
    return (
        windows.select("window", "size", "k")
        .distinct()
        .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
        .withColumn("gram", F.array_join(one, " "))
    )


def _places(docs: DataFrame, grams: DataFrame, k: int, small: bool) -> DataFrame:
    """``_id, _h, n_words, pos, gram``: where shingles of ``k`` words occur in documents."""
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(k)]
    terms = [F.col("terms").getField(str(i)) for i in range(k)]
    at = (
        docs.select(*KEY, words(F.col("text")).alias("words"))
        .select(*KEY, F.size("words").alias("n_words"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "terms"))
        .filter(terms[-1].isNotNull())
        .select(*KEY, "n_words", "pos", F.xxhash64(*terms).alias("mark"), F.concat_ws(" ", *terms).alias("here"))
    )
    split = F.split("gram", " ")
    sought = grams.filter(F.col("k") == k).select("gram", F.xxhash64(*[split[i] for i in range(k)]).alias("mark")).distinct()
    found = at.join(F.broadcast(sought) if small else sought, "mark")
    return found.filter(F.col("here") == F.col("gram")).select(*KEY, "n_words", "pos", "gram")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``_id, _h, start, size, window``: every place where a window occurs in a document of :func:`keyed`."""
    grams = stored(_grams(windows), "grams")
    sizes = [r["k"] for r in grams.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return docs.select(*KEY, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("window")).limit(0)
    small = grams.count() <= BROADCAST_GRAMS
    places = stored(reduce(DataFrame.unionByName, [_places(docs, grams, k, small) for k in sorted(sizes)]).distinct(), "places")

    frequency = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    prefixes = (
        grams.join(frequency, "gram")
        .groupBy("window", "size", "k")
        .agg(F.min(F.struct("n", "gram", "offset")).alias("rarest"), F.count(F.lit(1)).alias("present"))
        .filter(F.col("present") == F.col("size") - F.col("k") + 1)
        .select("window", "size", "k", "rarest.gram", "rarest.offset")
    )
    candidates = (
        places.join(prefixes, "gram")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .select(*KEY, "start", "size", "k", "window")
        .distinct()
    )
    last = F.col("size") - F.col("k")
    tiles = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("k")), F.array(last)))
    needed = (
        candidates.withColumn("tiles", tiles)
        .withColumn("tile", F.explode("tiles"))
        .select(*KEY, "start", "size", "window", F.size("tiles").alias("n_tiles"), (F.col("start") + F.col("tile")).alias("pos"),
                F.array_join(F.slice(F.split("window", " "), F.col("tile") + 1, F.col("k")), " ").alias("gram"))
    )
    verified = needed.join(places, [*KEY, "pos", "gram"], "left_semi")
    return (
        verified.groupBy(*KEY, "start", "size", "window", "n_tiles")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == F.col("n_tiles"))
        .select(*KEY, "start", "size", "window")
    )


def hit_documents(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``_id, _h, n_hit, items``: hit words and the ids of the occurring items, a row per hit document of :func:`keyed`."""
    windows = stored(item_windows(items, item_id, text, window, gram), "windows")
    hits = stored(occurrences(docs, windows), "hits")

    end = F.col("start") + F.col("size")
    earlier = Window.partitionBy(*KEY).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(end).over(earlier), F.lit(0))
    n_hit = (
        hits.select(*KEY, "start", "size")
        .distinct()
        .withColumn("new", F.greatest(end - F.greatest(F.col("start"), covered), F.lit(0)))
        .groupBy(*KEY)
        .agg(F.sum("new").alias("n_hit"))
    )
    found = (
        hits.select(*KEY, "window")
        .join(windows.select("window", "item"), "window")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return n_hit.join(found, KEY)


def contamination(
    df: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` of every document."""
    docs = keyed(df, doc_id, text)
    found = hit_documents(docs, items, item_id, item_text, window, gram)
    joined = docs.select(*KEY, "doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n_words")).join(found, KEY, "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        ids.alias("items"),
    )
