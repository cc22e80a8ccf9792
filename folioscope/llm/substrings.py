"""Exact removal of repeated substrings by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
document or another; strings never cross documents and are judged on the input.

No suffix array of a corpus fits one machine, so the strings are first dealt out by content: the key of
a string is the least hash among its substrings of ``gram`` bytes. Equal strings have equal keys.
Neighbouring strings mostly share a key; such a run is cut out as one segment. Keys that occur once are
dropped, equal segments are counted and kept once, and the segments of one key meet in one task.

There the segments of some keys are joined to a text, and its suffix array gives the Burrows-Wheeler
transform. Prefix intervals are then extended backwards, all of them at once: the suffixes that share
l + 1 symbols are those that share the first symbol and whose rests lie in one interval for l. Each round
so finds the boundaries whose common prefix is l, in increasing order, and the expansion stops at
``length``: what isn't separated by then starts with the same string. Intervals of several suffixes, or
of a segment that was counted more than once, are the repeated strings.

A key that has more than ``LARGEST_GROUP`` different segments, such as a common line in many contexts,
isn't gathered: its segments are dealt out again by longer grams, in the end by the whole string, where
all segments of a key are equal and so are one row.

Null texts are empty; texts shorter than ``length`` stay whole; equal rows repeat each other, so what
is long enough goes from all of them; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import KEY, keyed, stored

LENGTH = 200
#: Gram sizes by which strings are dealt out; the last one is the whole string.
GRAMS = (48, 140, LENGTH)
#: Different segments of one key that may meet in one task.
LARGEST_GROUP = 256
#: Bytes of segments that are sorted together.
SORTED_BYTES = 1 << 19
#: Strings whose keys are computed together, which bounds the memory for long texts.
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1

_TEXT = "k1 bigint, k2 bigint, n bigint"
_PLACE = f"{_TEXT}, key bigint, digest bigint, start bigint, strings bigint, anchors bigint"
_RUNS = "key bigint, digest bigint, firsts array<bigint>, lasts array<bigint>"


def _sliding(choose, values, width: int):
    """``choose`` (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = choose(values[:-span], values[span:])
        span *= 2
    return choose(values[: span - width], values[width - span :]) if width > span else values


class Keys:
    """Runs of strings with equal keys."""

    def __init__(self, gram: int, length: int):
        import numpy as np

        self.np, self.gram, self.length = np, gram, length
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        """Powers of the base and of its inverse modulo 2**64."""
        inverse = pow(_BASE, -1, 1 << 64)

        def powers(base: int):
            p = self.np.full(n, base, self.np.uint64)
            p[0] = 1
            return self.np.cumprod(p, dtype=self.np.uint64)

        self.up, self.down = powers(_BASE), powers(inverse)

    def _hashes(self, data):
        """Hashes of all grams of the bytes."""
        np, k = self.np, self.gram
        while len(data) > len(self.up):
            self._powers(2 * len(self.up))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[: len(data)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: len(data) - k + 1]
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    def _anchors(self, hashes, least, cuts, width: int):
        """How often each run has its key among its grams."""
        np = self.np
        edge = np.zeros(width - 1, np.uint64)
        highest = _sliding(np.maximum, np.concatenate([edge, least, edge]), width)
        at = np.flatnonzero(hashes == highest)  # grams that are the least of some string
        first = np.searchsorted(cuts, np.maximum(at - width + 1, 0), "right") - 1
        last = np.searchsorted(cuts, np.minimum(at, len(least) - 1), "right") - 1
        key, own = hashes[at], least[cuts]
        run = np.zeros(len(at), np.int64)
        for i in range(int((last - first).max()) + 1):
            r = np.minimum(first + i, last)
            run = np.where(own[r] == key, r, run)
        return np.bincount(run, minlength=len(cuts))

    def runs(self, raw: bytes) -> tuple[list, list, list, list]:
        """Keys, first starts, numbers of strings and numbers of anchors of the runs of ``raw``.

        A run with several anchors, as in text that repeats itself at once, may repeat its own strings.
        """
        np = self.np
        keys, starts, sizes, anchors = [], [], [], []
        for at in range(0, len(raw) - self.length + 1, _CHUNK):
            data = np.frombuffer(raw, np.uint8)[at : at + _CHUNK + self.length - 1]
            hashes, width = self._hashes(data), self.length - self.gram + 1
            least = _sliding(np.minimum, hashes, width)
            cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
            keys += least[cuts].view(np.int64).tolist()
            starts += (cuts + at).tolist()
            sizes += np.diff(np.append(cuts, len(least))).tolist()
            anchors += self._anchors(hashes, least, cuts, width).tolist()
        return keys, starts, sizes, anchors


def _places(texts: DataFrame, gram: int, length: int) -> DataFrame:
    """The runs of all texts (``k1, k2, n, raw``), with a digest of each run's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        keys = Keys(gram, length)
        names = [x.split()[0] for x in _PLACE.split(", ")]
        for batch in batches:
            out = [[] for _ in names]
            for k1, k2, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found, starts, sizes, anchors = keys.runs(raw)
                digests = [xxh64_intdigest(raw[s : s + m + length - 1]) for s, m in zip(starts, sizes)]
                signed = [d - (1 << 64) if d >> 63 else d for d in digests]
                rows = len(found)
                for column, values in zip(out, ([k1] * rows, [k2] * rows, [n] * rows, found, signed, starts, sizes, anchors)):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return texts.select("k1", "k2", "n", "raw").mapInArrow(run, _PLACE)


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``key, digest, n, raw``: the wanted segments, cut out of their texts."""
    joined = texts.select("k1", "k2", "raw").join(wanted, ["k1", "k2"])
    one = F.explode("segments").alias("s")
    return joined.select("raw", one).select(
        "s.key", "s.digest", "s.n", F.substring("raw", F.col("s.start") + 1, F.col("s.strings") + length - 1).alias("raw")
    )


def suffix_array(symbols):
    """Starts of the suffixes in order; the last symbol is less than all others."""
    import numpy as np

    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(6, np.uint64)])
    first = np.zeros(n, np.uint64)
    for i in range(6):  # symbols have 9 bits
        first = first << np.uint64(9) | padded[i : i + n]
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    # A suffix's rank is the place of the first one that equals it as far as compared.
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 6
    while not new.all():
        # Only suffixes that share their rank are compared further.
        shared = ~new
        shared[:-1] |= ~new[1:]
        places = np.flatnonzero(shared)
        suffixes = order[places]
        rest = np.where(suffixes + width < n, rank[np.minimum(suffixes + width, n - 1)], -1)
        sort = np.argsort(rank[suffixes] * (n + 1) + rest + 1)
        suffixes, rest, own = suffixes[sort], rest[sort], rank[suffixes][sort]
        order[places] = suffixes
        cut = np.concatenate([[True], (own[1:] != own[:-1]) | (rest[1:] != rest[:-1])])
        new[places] |= cut
        rank[suffixes] = places[np.flatnonzero(cut)[np.cumsum(cut) - 1]]
        width *= 2
    return order


def intervals(transform, length: int):
    """For each suffix in order, the number of its interval for ``length`` symbols, from the transform alone.

    Symbol 0 separates texts: no interval goes past it.
    """
    import numpy as np

    # The place of each suffix's rest: the transform's symbols in stable order.
    rest = np.argsort(transform, kind="stable")
    symbol = transform[rest]
    boundary = np.concatenate([[True], symbol[1:] != symbol[:-1]]) | (symbol == 0)
    found = boundary.copy()
    left = np.flatnonzero(~boundary)
    before, after, origin = rest[left - 1], rest[left], np.arange(len(boundary))
    for _ in range(length - 1):
        same = np.ones(len(left), bool)
        if 2 * len(left) < len(boundary):
            # Suffixes that are alone in their interval leave; whoever's rest is one of them parts now.
            stays = ~boundary
            stays[:-1] |= ~boundary[1:]
            kept, place = np.flatnonzero(stays), np.cumsum(stays) - 1
            same = stays[before] & stays[after]
            boundary = boundary[kept]
            boundary[1:] |= kept[1:] != kept[:-1] + 1
            origin, left, before, after = origin[kept], place[left], place[before], place[after]
        interval = np.cumsum(boundary, dtype=np.int32)
        same &= interval[before] == interval[after]
        if same.all():
            break
        apart = left[~same]
        boundary[apart] = True
        found[origin[apart]] = True
        left, before, after = left[same], before[same], after[same]
    return np.cumsum(found) - 1


def repeated_strings(segments: list[bytes], counts: list[int], length: int) -> list[tuple[list, list]]:
    """For each segment, first and last starts of the runs of strings that occur more than once.

    Segments are different; ``counts`` tells how often each occurs.
    """
    import numpy as np

    sizes = np.array([len(s) + 1 for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes) - 1
    text[ends] = 0
    order = suffix_array(text)
    transform = text[order - 1]
    groups = intervals(transform, length)
    owner = np.repeat(np.arange(len(segments)), sizes)
    weight = np.bincount(groups, weights=np.array(counts, float)[owner[order]])
    repeated = np.zeros(len(text) + 1, bool)
    repeated[order] = weight[groups] > 1
    starts = np.arange(len(text))
    repeated[:-1] &= starts + length <= ends[owner]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated]).astype(np.int8)))
    out: list[tuple[list, list]] = [([], []) for _ in segments]
    offsets = ends - sizes + 1
    for first, last in zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()):
        which = int(owner[first])
        out[which][0].append(first - int(offsets[which]))
        out[which][1].append(last - int(offsets[which]))
    return out


def _expand(segments: DataFrame, length: int) -> DataFrame:
    """``key, digest, firsts, lasts`` of the segments with repeated strings; the rows of a key are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RUNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def flush(rows: list) -> pa.RecordBatch:
            runs = repeated_strings([r[3] for r in rows], [r[2] for r in rows], length)
            found = [(r[0], r[1], *x) for r, x in zip(rows, runs) if x[0]]
            columns = zip(*found) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if rows and rows[-1][:2] == row[:2]:
                    continue  # cut out of each of several equal documents
                if size >= SORTED_BYTES and rows[-1][0] != row[0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(rows)

    dealt = segments.select("key", "digest", "n", "raw").repartition("key").sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(run, _RUNS)


def repeated_runs(
    texts: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, largest_group: int = LARGEST_GROUP
) -> DataFrame:
    """``k1, k2, firsts, lasts, start``: runs of repeated strings in texts (``k1, k2, n, raw``), per segment.

    ``n`` tells how often a text occurs; first and last starts of strings count from ``start``.
    """
    found = stored(_places(texts, grams[0], length), "strings")
    totals = found.groupBy("key").agg(F.sum(F.col("n") * F.col("anchors")).alias("total"))
    keys = stored(totals.filter(F.col("total") > 1).select("key"), "keys")
    places = stored(found.drop("anchors").join(keys, "key", "left_semi"), "places")
    distinct = places.groupBy("key", "digest").agg(
        F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "start", "strings")).alias("at")
    )
    wanted = distinct.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("key", "digest", "n", "at.start", "at.strings")).alias("segments")
    )
    segments = stored(_cut(texts, wanted, length), "segments")
    large = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest_group).select("key")
    large = stored(large, "large")
    if len(grams) == 1 or large.isEmpty():
        runs = _expand(segments, length)
    else:
        spread = segments.join(large, "key", "left_semi").dropDuplicates(["key", "digest"])
        again = spread.select(F.col("key").alias("k1"), F.col("digest").alias("k2"), "n", "raw")
        # One row for each segment, however many runs of longer grams it was cut into.
        parts = repeated_runs(again, length, grams[1:], largest_group)
        shifted = {c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start")))) for c in ("firsts", "lasts")}
        further = parts.groupBy(F.col("k1").alias("key"), F.col("k2").alias("digest")).agg(
            *[part.alias(c) for c, part in shifted.items()]
        )
        runs = _expand(segments.join(large, "key", "left_anti"), length).unionByName(further)
    return places.select("k1", "k2", "key", "digest", "start").join(runs, ["key", "digest"]).drop("key", "digest")


def _removed(text: Column, runs: Column, length: int) -> Column:
    """``n_bytes, n_removed, n_spans, kept`` of a text and its runs (start, firsts, lasts)."""

    def cut(raw: bytes, found: list[dict] | None) -> tuple:
        spans: list[list[int]] = []
        pairs = ((r["start"] + a, r["start"] + b + length) for r in found or () for a, b in zip(r["firsts"], r["lasts"]))
        for a, b in sorted(pairs):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        edges = [0, *(x for span in spans for x in span), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = [cut(t.as_py() or b"", f.as_py()) for t, f in zip(texts, found)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    run.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>"
    return F.arrow_udf(run, kind)(text, runs)


def remove_repeats(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    grams: tuple[int, ...] = GRAMS,
    largest_group: int = LARGEST_GROUP,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that are left) of every document."""
    docs = keyed(df, doc_id, text).select(
        *KEY, "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("raw")
    )
    texts = docs.select(F.col("_id").alias("k1"), F.col("_h").alias("k2"), F.lit(1).cast("bigint").alias("n"), "raw")
    runs = repeated_runs(texts, length, grams, largest_group)
    # Equal rows have the same places, each as often as there are rows.
    of_text = runs.groupBy(F.col("k1").alias("_id"), F.col("k2").alias("_h")).agg(
        F.collect_set(F.struct("start", "firsts", "lasts")).alias("runs")
    )
    joined = docs.join(of_text, KEY, "left").select("doc_id", _removed(F.col("raw"), F.col("runs"), length).alias("r"))
    return joined.select("doc_id", "r.*")
