"""Prefix trie of conversations: what they share, as counts per node.

Each distinct sequence of first turns (role, text) is a node; the root has none. A conversation is one
binary value, ``RECORD`` bytes per turn: 16 of a digest of role and text, 8 of the text's size. Equal
conversations become one row with a count before they are sorted, so copies stay together cheaply and a
very common first turn is cut wherever the rows after it differ.

The sorted sequences are cut into shards of at most ``SHARD_TURNS`` turns. A shard keeps its trie as
balanced parentheses in preorder, with the least excess of every block in a tree: ``findclose`` delimits a
node's subtree, the rank of the pairs ``()`` counts its leaves, and differences of cumulative arrays in
preorder give conversations and savings. All nodes of a shard but those on its first and last sequence lie
in it alone and are final. The others, the spines, are shared with neighbours: they leave the shard with
what hangs from them directly, and one more trie, over two sequences per shard, merges them.

Conversations are ordered by turn, nulls first; rows of one turn by digest; null roles and texts are empty.
Rows without conv_id belong to no conversation. An empty table has no nodes. Other columns aren't looked at.
A conversation is held as one value (24 bytes a turn, no texts), so its length is bounded by memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

RECORD = 24
#: Turns after which a shard ends.
SHARD_TURNS = 1 << 18
#: Text of ids that is joined before it is sent on.
CHUNK_BYTES = 1 << 20
#: First turns of another conversation that ``graft`` puts before a conversation's own, at most.
MOST_GRAFTED = 8

_NONE = np.iinfo(np.int64).max
_SPARSE = ["members", "least", "children", "leaves", "saved"]
_ROWS = pa.schema(
    [(n, pa.int64()) for n in ("kind", "shard", "side", "hangs")]
    + [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("end_key", pa.binary()), ("path", pa.binary())]
    + [(n, pa.list_(pa.int64())) for n in _SPARSE]
    + [("keys", pa.list_(pa.binary()))]
)
_DDL = (
    "kind bigint, shard bigint, side bigint, hangs bigint, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end_key binary, path binary, "
    "members array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, "
    "keys array<binary>"
)
_NODE, _SPINE, _NAMES = 0, 1, 2
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


class Parentheses:
    """A balanced sequence with its excess, in blocks under a tree of least values."""

    BLOCK = 64

    def __init__(self, opens: np.ndarray):
        self.excess = np.cumsum(np.where(opens, 1, -1))
        self.opened = np.flatnonzero(opens)
        pairs = np.zeros(len(opens) + 1, np.int64)
        np.cumsum(opens[:-1] & ~opens[1:], out=pairs[1:-1])
        pairs[-1] = pairs[-2]
        self._pairs = pairs
        n = -(-len(opens) // self.BLOCK)
        self._blocks = np.full(n * self.BLOCK, _NONE, np.int64)
        self._blocks[: len(opens)] = self.excess
        self._blocks = self._blocks.reshape(n, self.BLOCK)
        self._least = [self._blocks.min(axis=1)]
        while len(self._least[-1]) > 1:
            level = self._least[-1]
            if len(level) % 2:
                level = self._least[-1] = np.append(level, _NONE)
            self._least.append(level.reshape(-1, 2).min(axis=1))

    def leaves_before(self, at: np.ndarray) -> np.ndarray:
        """Pairs ``()`` that begin before the places."""
        return self._pairs[at]

    def _first_in_block(self, block: np.ndarray, after: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place of a block, beyond column ``after``, whose excess isn't above ``goal``; -1 if none."""
        found = np.empty(len(block), np.int64)
        columns = np.arange(self.BLOCK)
        for lo in range(0, len(block), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            good = (self._blocks[block[part]] <= goal[part, None]) & (columns > after[part, None])
            column = good.argmax(axis=1)
            hit = good[np.arange(len(column)), column]
            found[part] = np.where(hit, block[part] * self.BLOCK + column, -1)
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The places that close the parentheses opened at ``at``."""
        goal = self.excess[at] - 1
        block = at // self.BLOCK
        found = self._first_in_block(block, at % self.BLOCK, goal)
        far = np.flatnonzero(found < 0)
        if len(far):
            node, goal = block[far], goal[far]
            height = np.full(len(far), -1)
            for h, least in enumerate(self._least[:-1]):
                up = height < 0
                side = np.minimum(node + 1, len(least) - 1)
                here = up & (node % 2 == 0) & (least[side] <= goal)
                node = np.where(here, node + 1, np.where(up, node // 2, node))
                height[here] = h
            for h in range(len(self._least) - 2, 0, -1):
                down = height >= h
                left = 2 * node
                below = self._least[h - 1][np.where(down, left, 0)] <= goal
                node = np.where(down, left + ~below, node)
            found[far] = self._first_in_block(node, np.full(len(far), -1), goal)
        return found


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with in common."""
    low, high = 0, min(len(a), len(b)) // RECORD
    step = 1
    while low < high:
        to = min(low + step, high)
        if a[low * RECORD : to * RECORD] == b[low * RECORD : to * RECORD]:
            low, step = to, step * 2
        elif step == 1:
            break
        else:
            high, step = to, 1
    return low


class Trie:
    """The nodes of sorted distinct sequences, numbered in preorder from the root, 0."""

    def __init__(self, paths: list[bytes], chains: bool = False):
        counts, parent, depth, fresh, stack = [], [-1], [0], [], [0]
        #: The node at which each sequence ends, and on request all nodes of each.
        self.ends: list[int] = []
        self.chains: list[list[int]] = []
        before = b""
        for path in paths:
            same, n = _common(before, path), len(path) // RECORD
            counts += [len(stack) - 1 - same, n - same]
            first = len(parent)
            del stack[same + 1 :]
            if n > same:
                parent.append(stack[-1])
                parent.extend(range(first, first + n - same - 1))
                depth.extend(range(same + 1, n + 1))
                stack.extend(range(first, first + n - same))
                fresh.append(path[same * RECORD :])
            self.ends.append(stack[-1])
            if chains:
                self.chains.append(stack[:])
            before = path
        self.last = stack
        # Runs of opened and closed ones in turn: the root, per sequence what closes and opens, and the end.
        runs = [1, *counts, len(stack)]
        self.tree = Parentheses(np.repeat(np.resize([True, False], len(runs)), runs))
        self.parent, self.depth = parent, np.array(depth)
        records = np.frombuffer(b"".join(fresh), np.uint8).reshape(-1, RECORD)
        sizes = np.ascontiguousarray(records[:, 16:]).view(">u8").ravel().astype(np.int64)
        self.sizes = np.concatenate([[0], sizes])
        opened = self.tree.opened
        closed = self.tree.findclose(opened)
        self.n_leaves = self.tree.leaves_before(closed) - self.tree.leaves_before(opened)
        self._after = np.arange(len(opened)) + (closed - opened + 1) // 2

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, their tops included."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self._after] - total[:-1]

    def least(self, values: np.ndarray) -> np.ndarray:
        """Least values over subtrees."""
        found, parent = values.tolist(), self.parent
        for k in range(len(found) - 1, 0, -1):
            if found[k] < found[parent[k]]:
                found[parent[k]] = found[k]
        return np.array(found, np.int64)

    def n_children(self) -> np.ndarray:
        return np.bincount(self.parent[1:], minlength=len(self.parent)) if len(self.parent) > 1 else np.zeros(1, np.int64)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    found = [columns.get(f.name, [None] * n) for f in _ROWS]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, _ROWS)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ROWS)


def _shard(shard: int, paths: list[bytes], n_convs: list[int], convs: list[int], keys: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Final rows of the inner nodes of a shard, and its spines."""
    trie = Trie(paths)
    n, parent = len(trie.parent), np.array(trie.parent)
    members, least = np.zeros(n, np.int64), np.full(n, _NONE, np.int64)
    members[trie.ends], least[trie.ends] = n_convs, convs
    end_key: list[bytes | None] = [None] * n
    for k, key in zip(trie.ends, keys):
        end_key[k] = key
    own, first_ends = members.copy(), least.copy()
    members, least = trie.below(members), trie.least(least)
    saved = trie.below((members - 1) * trie.sizes)
    # The side of a node: its first sequence, its last one, or none.
    side = np.full(n, -1)
    side[trie.last] = 1
    side[: len(paths[0]) // RECORD + 1] = 0
    inner = np.flatnonzero(side < 0)
    above = parent[inner]
    hangs = side[above] >= 0
    columns = {
        "kind": np.full(len(inner), _NODE),
        "shard": np.full(len(inner), shard),
        "side": pa.array(side[above], mask=~hangs),
        "hangs": pa.array(trie.depth[above], mask=~hangs),
        "conv_id": least[inner],
        "depth": trie.depth[inner],
        "parent_conv_id": pa.array(least[above], mask=hangs),
        "n_convs": members[inner],
        "n_children": trie.n_children()[inner],
        "n_leaves": trie.n_leaves[inner],
        "saved_tokens": saved[inner],
        "end_key": [end_key[k] for k in inner],
    }
    yield _batch(columns, len(inner))
    top, to = inner[hangs], above[hangs]
    kids, leaves, left = (np.zeros(n, np.int64) for _ in range(3))
    np.add.at(own, to, members[top])
    np.minimum.at(first_ends, to, least[top])
    np.add.at(kids, to, 1)
    np.add.at(leaves, to, trie.n_leaves[top])
    np.add.at(left, to, saved[top])
    out: dict[str, list] = {c: [] for c in ["kind", "shard", "side", "path", "keys", *_SPARSE]}
    for s, path, chain in ((0, paths[0], list(range(len(paths[0]) // RECORD + 1))), (1, paths[-1], trie.last)):
        if s and len(paths) == 1:
            break
        chain = np.array(chain)
        mine = side[chain] == s
        row = [_SPINE, shard, s, path, [end_key[k] if m else None for k, m in zip(chain, mine)]]
        empty = [0, _NONE, 0, 0, 0]
        row += [np.where(mine, v[chain], e).tolist() for v, e in zip((own, first_ends, kids, leaves, left), empty)]
        for c, value in zip(out, row):
            out[c].append(value)
    yield _batch(out, len(out["kind"]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    turns = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            rows.append(row)
            turns += len(row[0]) // RECORD
            if turns >= SHARD_TURNS:
                yield from _shard(number, *map(list, zip(*rows)))
                rows, turns, number = [], 0, number + 1
    if rows:
        yield from _shard(number, *map(list, zip(*rows)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final rows of the nodes on spines, and per spine the ``conv_id`` of each of its nodes."""
    tables = [b for b in batches if len(b)]
    if not tables:
        return
    rows = pa.Table.from_batches(tables).to_pylist()
    trie = Trie([r["path"] for r in rows], chains=True)
    n = len(trie.parent)
    own = {c: np.full(n, _NONE if c == "least" else 0, np.int64) for c in _SPARSE}
    end_key: list[bytes | None] = [None] * n
    for row, chain in zip(rows, trie.chains):
        for c in _SPARSE:
            if c == "least":
                own[c][chain] = np.minimum(own[c][chain], row[c])
            else:
                own[c][chain] += np.array(row[c])
        for k, key in zip(chain, row["keys"]):
            end_key[k] = key if key is not None else end_key[k]
    members, least = trie.below(own["members"]), trie.least(own["least"])
    children = own["children"] + trie.n_children()
    columns = {
        "kind": np.full(n, _NODE),
        "conv_id": least,
        "depth": trie.depth,
        "parent_conv_id": [None, *least[trie.parent[1:]].tolist()],
        "n_convs": members,
        "n_children": children,
        "n_leaves": trie.below(own["leaves"] + (children == 0)),
        "saved_tokens": trie.below(own["saved"] + (members - 1) * trie.sizes),
        "end_key": end_key,
    }
    yield _batch(columns, n)
    names = {
        "kind": [_NAMES] * len(rows),
        "shard": [r["shard"] for r in rows],
        "side": [r["side"] for r in rows],
        "least": [least[chain].tolist() for chain in trie.chains],
    }
    yield _batch(names, len(rows))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each sequence joined by commas, in pieces of bounded size."""
    schema = pa.schema([("end_key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids, size = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != key or size >= CHUNK_BYTES):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            key = k
            ids.append(i)
            size += 20
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all pieces of a sequence, one after the other."""
    schema = pa.schema([("end_key", pa.binary()), ("ends_sha256", pa.string())])
    key, digest = None, None
    out: list[tuple] = []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, the records of its turns in order as hexadecimal text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")
    record = F.concat(F.substring(F.sha2(spelled.cast("binary"), 256), 1, 32), size)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), record.alias("record")).alias("row")
    )
    turns = F.sort_array(F.collect_list("row"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: t["record"]).alias("turns"))


def graft(found: DataFrame, onto: Column, n: Column) -> DataFrame:
    """``found`` with the first ``n`` turns of conversation ``onto`` (none if absent) in place of its own."""
    heads = found.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, MOST_GRAFTED).alias("head"))
    own = found.select("conv_id", "turns", onto.alias("onto"), n.cast("int").alias("n"))
    joined = own.join(heads, F.col("onto") == F.col("head_id"), "left")
    head = F.slice(F.coalesce(F.col("head"), F.array().cast("array<string>")), F.lit(1), F.col("n"))
    tail = F.slice(F.col("turns"), F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def nodes(found: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv_id`` and ``turns``.

    ``conv_id`` is the least of the conversations that begin with the node's turns, ``n_convs`` their
    number; ``parent_conv_id`` is the parent's (null for the root); ``n_leaves`` and ``saved_tokens`` are
    over the subtree; ``ends_sha256`` is the digest of the ids that end here, in order, joined by commas.
    """
    path = F.unhex(F.array_join("turns", ""))
    key = F.unhex(F.substring(F.sha2(F.col("path"), 256), 1, 32))
    paths = stored(found.select("conv_id", path.alias("path")).withColumn("end_key", key), "trie-paths")
    distinct = paths.groupBy("path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("end_key").alias("end_key")
    )
    distinct = stored(distinct, "trie-distinct")
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path", "n", "conv_id", "end_key")
    inner = stored(ordered.mapInArrow(_shards, _DDL), "trie-shards")
    spines = inner.filter(F.col("kind") == _SPINE).coalesce(1).sortWithinPartitions("path")
    merged = stored(spines.mapInArrow(_merge, _DDL), "trie-spines")

    names = merged.filter(F.col("kind") == _NAMES).select("shard", "side", "least")
    rows = inner.filter(F.col("kind") == _NODE)
    known = rows.filter(F.col("hangs").isNull()).unionByName(merged.filter(F.col("kind") == _NODE))
    hanging = rows.filter(F.col("hangs").isNotNull()).drop("least").join(names, ["shard", "side"])
    hanging = hanging.withColumn("parent_conv_id", F.element_at("least", (F.col("hangs") + 1).cast("int")))
    every = known.select(*NODE_COLUMNS, "end_key").unionByName(hanging.select(*NODE_COLUMNS, "end_key"))

    ids = paths.select("end_key", "conv_id").repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id")
    chunks = ids.mapInArrow(_chunks, "end_key binary, first bigint, ids string")
    chunks = chunks.repartition("end_key").sortWithinPartitions("end_key", "first")
    digests = chunks.mapInArrow(_digests, "end_key binary, ends_sha256 string")
    ending = every.filter(F.col("end_key").isNotNull()).join(digests, "end_key", "left").select(*NODE_COLUMNS, "ends_sha256")
    passing = every.filter(F.col("end_key").isNull()).select(*NODE_COLUMNS, F.sha2(F.lit(b""), 256).alias("ends_sha256"))
    return ending.unionByName(passing)


def rebuilt_trie(conversations: DataFrame, n: Callable[[Column], Column], every: int = 5) -> DataFrame:
    """``nodes`` of all conversations, each with its first ``n(conv_id)`` turns taken from the last one whose
    id ``every`` divides."""
    found = sequences(conversations)
    return nodes(graft(found, F.col("conv_id") - F.col("conv_id") % every, n(F.col("conv_id"))))
