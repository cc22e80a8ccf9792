"""Near-duplicates by SimHash, found through covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the 64-bit hashes of the
text's shingles. Two documents link when their fingerprints differ in at most ``radius`` bits.

Bit ``i`` of a fingerprint gets a non-zero vector of ``radius + 1`` bits; the mask of each non-zero ``v``
has the bits whose vector has an odd product with ``v``. Of ``radius`` bits that differ, some ``v`` is
orthogonal to all vectors, so its mask has none of them: every pair within the radius agrees on the
bits of at least one mask, and meets in that mask's table. A group of a table that has more than
``LARGEST_GROUP`` fingerprints is spread anew by masks of the bits that it doesn't share yet, which
guarantee the same among its members; this ends, as few bits leave few different fingerprints.

Only different fingerprints are compared, so copies cost one row whatever their number, and a group
gives a spanning set of its links, not its pairs. Nulls and texts without words have fingerprint zero
and link like any other; a null doc_id is never a component's id unless all are null; repeated rows
share a component; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import KEY, keyed, stored
from folioscope.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that one task compares with one another; larger groups are spread further.
LARGEST_GROUP = 1024
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts.tolist(), last)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint of a text column, as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(x.as_py(), width)) for x in texts], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(text.cast("binary"))


@lru_cache(maxsize=None)
def masks(shared: int = 0, radius: int = RADIUS) -> tuple[int, ...]:
    """Masks that cover the bits outside ``shared``, each with the bits of ``shared`` added."""
    free = [i for i in range(64) if not shared >> i & 1]
    # Unit vectors come first: with more than ``radius`` free bits each mask then has at least one of them.
    vectors = sorted(range(1, 1 << radius + 1), key=lambda v: (v.bit_count(), v))
    own = {bit: vectors[i % len(vectors)] for i, bit in enumerate(free)}
    found = {shared | sum(1 << bit for bit in free if (own[bit] & v).bit_count() % 2) for v in vectors}
    return tuple(sorted(found))


def _further_masks(mask: Column, radius: int) -> Column:
    def run(shared: pa.Array) -> pa.Array:
        made = [[_signed(m) for m in masks(x & _ALL, radius)] for x in shared.to_pylist()]
        return pa.array(made, pa.list_(pa.int64()))

    run.__annotations__ = {"shared": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<bigint>")(mask)


def _group_links(members: Column, radius: int) -> Column:
    """For a group of fingerprints, each one linked within the group with the first one it can reach."""

    def links(group: list[int]) -> list[dict]:
        import numpy as np

        if len(group) == 2:
            a, b = group
            return [{"a": a, "b": b}] if ((a ^ b) & _ALL).bit_count() <= radius else []
        x = np.array(group, np.int64)
        near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
        left, out = np.ones(len(x), bool), []
        for i in range(len(x)):
            if not left[i]:
                continue
            reached = near[i] & left
            while (more := near[reached].any(axis=0) & left & ~reached).any():
                reached |= more
            left &= ~reached
            out += [{"a": group[i], "b": group[j]} for j in np.flatnonzero(reached) if j != i]
        return out

    def run(groups: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.array([links(g) for g in groups.to_pylist()], kind)

    run.__annotations__ = {"groups": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<a:bigint,b:bigint>>")(members)


def near_links(prints: DataFrame, radius: int = RADIUS, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """``a, b``: pairs that connect what fingerprints within the radius connect. ``prints`` has distinct ``print``."""
    # Members of a group that differ in ``radius`` bits at most all link, and are no more than this.
    largest_group = max(largest_group, 1 << radius)
    rows = prints.select("print", F.explode(F.array(*[F.lit(_signed(m)) for m in masks(0, radius)])).alias("mask"))
    found = []
    while True:
        # Groups are mostly of one, so rows are sent as they are: combined first, a task would hold its prints once per mask.
        rows = rows.withColumn("shared", F.col("print").bitwiseAND(F.col("mask")))
        groups = rows.repartition("mask", "shared").groupBy("mask", "shared")
        large = stored(groups.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest_group), "large")
        last = large.isEmpty()
        small = rows if last else rows.join(large, ["mask", "shared"], "left_anti")
        members = small.repartition("mask", "shared").groupBy("mask", "shared").agg(F.collect_list("print").alias("members"))
        linked = members.filter(F.size("members") > 1).select(_group_links(F.col("members"), radius).alias("links"))
        found.append(linked.select(F.inline("links")))
        if last:
            break
        spread = rows.join(large, ["mask", "shared"], "left_semi")
        rows = stored(spread.select("print", F.explode(_further_masks(F.col("mask"), radius)).alias("mask")).distinct(), "spread")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    width: int = SHINGLE,
    largest_group: int = LARGEST_GROUP,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` (the least doc_id reachable), ``root`` and the key of each row.

    ``root`` is a fingerprint that names the component, also where no member has an id.
    """
    docs = stored(keyed(df, doc_id, text).select(*KEY, "doc_id", fingerprints(F.col("text"), width).alias("print")), "prints")
    prints = docs.groupBy("print").agg(F.min("doc_id").alias("least"))
    linked = components(near_links(prints.select("print"), radius, largest_group), "a", "b")
    members = prints.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.select("print", "root").join(ids, "root")
    return docs.join(classes, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
        *KEY,
    )
