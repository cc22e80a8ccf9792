"""Line dedup by winnowing over line hashes.

A document is the sequence of its non-blank lines, white space made single. From each window of ``run``
lines the least line hash (the last of equal ones) is selected, so any ``run`` consecutive lines that
two places share have the same line selected in both. Selected lines that occur once are dropped; the
others are joined over their positions: each carries the lines around it, as far as the windows that
selected it reach to both sides, and equal windows are matched with their first place. Matched windows
of a document that overlap or touch make up a run, so runs extend as far as the match does.

A line can be a paragraph, so size counts as well as lines: fewer than ``run`` lines that hold ``WORDS``
words or ``BYTES`` bytes together are a window of their own, which is its own anchor.

A place is later than another by doc_id (null last), then by position. Every line of a window that
has an earlier place goes; the first place stays. Blank lines go with the line before them.

Windows are counted and their first place found with map-side combine, so a line or passage that a
third of all documents share costs a row per task; only the join that brings the first place back
meets all its windows, and it can be split.

Null texts stay null; an empty text stays; short texts of fewer lines than ``run`` stay whole; rows equal
in id and text are one document and get the same verdict; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import KEY, keyed, keyed_rows, stored

#: Repeats of at least so many lines are found, without exception.
RUN = 3
#: So are repeats of fewer lines that hold so many words or bytes; nothing shorter goes. Scripts without
#: spaces need the bytes.
WORDS, BYTES = 50, 300

_ANCHORS = "_id bigint, _h bigint, no_id boolean, anchor bigint, first bigint, around array<bigint>"


def line_hashes(raw: bytes) -> tuple[list[int], list[int], list[int]]:
    """Of the non-blank lines, white space made single: hashes, numbers of words and of bytes."""
    from xxhash import xxh64_intdigest

    words = [w for w in (line.split() for line in raw.split(b"\n")) if w]
    joined = [b" ".join(w) for w in words]
    return [xxh64_intdigest(x) for x in joined], [len(w) for w in words], [len(x) for x in joined]


def _windows(doc, size: int):
    """The first lines of all windows of ``size`` lines that lie in one document; ``doc`` is each line's."""
    import numpy as np

    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)


def winnow(hashes, run: int, doc=None):
    """Rows of a selected line and the first lines of the first and the last window that selected it.

    ``doc`` is each line's document, if there is more than one.
    """
    import numpy as np

    first = _windows(np.zeros(len(hashes)) if doc is None else doc, run)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    values = hashes[first[:, None] + np.arange(run)]
    chosen = first + run - 1 - values[:, ::-1].argmin(axis=1)
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(chosen)]]) - 1
    return np.stack([chosen[begins], first[begins], first[ends]], axis=1)


def large_windows(doc, words, size, n: int):
    """First lines of the windows of ``n`` lines with ``WORDS`` words or ``BYTES`` bytes."""
    import numpy as np

    first = _windows(doc, n)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (words, size)]
    of = [s[first + n] - s[first] for s in sums]
    return first[(of[0] >= WORDS) | (of[1] >= BYTES)]


def _mixed(x):
    """A 64-bit number whose bits all depend on all of ``x``'s."""
    import numpy as np

    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def anchors(df: DataFrame, doc_id: str, text: str, run: int, large: bool) -> DataFrame:
    """The selected lines of all documents, each with the lines around it, and the large windows."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = [line_hashes(raw or b"") for raw in batch.column(3).to_pylist()]
            counts = np.array([len(f[0]) for f in found], np.int64)
            hashes, words, size = (np.concatenate([np.array(f[k], kind) for f in found] or [np.zeros(0, kind)]) for k, kind in enumerate((np.uint64, np.int64, np.int64)))
            signed = hashes.view(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            begin = np.cumsum(counts) - counts
            line, first, last = winnow(signed, run, doc).T
            parts = [(signed[line], first, last - first + run)]
            for n in range(1, run) if large else ():
                at = large_windows(doc, words, size, n)
                # Starting from its length tells a window from lines and from other lengths.
                key = np.full(len(at), n, np.uint64)
                for k in range(n):
                    key = _mixed(key + hashes[at + k])
                parts.append((key.view(np.int64), at, np.full(len(at), n)))
            anchor, first, length = (np.concatenate(c) for c in zip(*parts))
            ends = np.concatenate([[0], np.cumsum(length)])
            around = signed[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
            of = doc[first] if len(first) else np.zeros(0, np.int64)
            columns = [batch.column(k).take(pa.array(of)) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(around, pa.int64()))
            columns += [pa.array(anchor, pa.int64()), pa.array(first - begin[of], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ANCHORS.split(", ")])

    docs = keyed(df, doc_id, text)
    columns = docs.select(*KEY, F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("binary").alias("text"))
    return columns.mapInArrow(select, _ANCHORS)


def repeated_windows(found: DataFrame, run: int) -> DataFrame:
    """``_id, _h, start, n``: windows of ``n`` lines, ``run`` or a large one's, that have an earlier place."""
    counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    # Written first, the small sides leave the joins free to split a hot anchor or window.
    repeated = stored(counts.filter(F.col("n") > 1).select("anchor"), "anchors")
    # Lines around a selected one are ``run`` or more; fewer are a large window as it is.
    n = F.least(F.size("around"), F.lit(run))
    at = F.sequence(F.lit(0), F.size("around") - n)
    windows = (
        found.join(repeated, "anchor", "left_semi")
        .withColumn("shift", F.explode(at))
        .select(
            *KEY,
            F.slice("around", F.col("shift") + 1, n).alias("window"),
            F.struct("no_id", "_id", "_h", (F.col("first") + F.col("shift")).alias("start")).alias("place"),
        )
    )
    places = windows.groupBy("window").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n"))
    firsts = stored(places.filter(F.col("n") > 1).select("window", "earliest"), "windows")
    later = windows.join(firsts, "window").filter(F.col("place") > F.col("earliest"))
    return later.select(*KEY, F.col("place.start").alias("start"), F.size("window").alias("n"))


def without_lines(text: Column, windows: Column) -> Column:
    """``text`` without the lines of the windows, with the numbers of non-blank lines before and removed."""

    def cut(raw: bytes | None, windows: list[dict] | None) -> tuple:
        if raw is None:
            return None, 0, 0
        gone = {w["start"] + i for w in windows or () for i in range(w["n"])}
        kept, at, n = [], -1, 0
        for line in raw.split(b"\n"):
            filled = bool(line.strip())
            at += filled
            if at in gone:
                n += filled
            else:
                kept.append(line)
        return (b"\n".join(kept) if n else raw).decode("utf-8", "replace"), at + 1, n

    def run_all(texts: pa.Array, windows: pa.Array) -> pa.Array:
        rows = [cut(t.as_py(), w) for t, w in zip(texts, windows.to_pylist())]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["text", "n_lines", "n_removed"])

    run_all.__annotations__ = {"texts": pa.Array, "windows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run_all, "struct<text:string,n_lines:bigint,n_removed:bigint>")(text.cast("binary"), windows)


def dedup_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, large: bool = True
) -> DataFrame:
    """``row`` (the row of ``df``) and ``lines``: the text that is left, ``n_lines`` and ``n_removed``.

    Without ``large`` only windows of ``run`` lines count, however long their lines are.
    """
    # Written once: the lines are read and hashed here only.
    found = stored(anchors(df, doc_id, text, run, large), "line-anchors")
    gone = (
        repeated_windows(found, run)
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    )
    joined = keyed_rows(df, doc_id, text).join(gone, KEY, "left")
    return joined.select("row", without_lines(F.col("row")[text], F.col("windows")).alias("lines"))
