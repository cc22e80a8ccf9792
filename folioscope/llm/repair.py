"""Repair of conversation structure as a cheapest path, found by the auction algorithm.

A conversation keeps its order of roles ``(s?(ua)+)?`` after edits of its rows: Keep, Rerole, Delete, and
Insert of an empty message. Its rows and the four states that a prefix can leave (nothing, s, user's turn
done, assistant's turn done) are the nodes of a lattice with whole numbers as costs. The auction algorithm
grows one path from the start: the node at its end pays the least cost of going on, and either the path
extends along that arc, or the node's price rises to it and the path contracts. Prices never exceed the
cost of the arc and the next node's price, so when the goal is reached, the start's price is the least cost,
and the cheapest paths are those of tight arcs, whose cost is the difference of the prices.

The lattice is worked through from its end in blocks of ``BLOCK`` rows: an auction for each state at a
block's begin, with the exact prices of the next block at its end. So long conversations take time in
proportion to their rows. A trace over tight arcs that lead to the goal takes the least initial each time.

Rows are reduced to a digest and a class before the first shuffle; texts are read again only to write the
repaired conversation, row after row. Both steps stream: a task holds digests (16 bytes a row) and prices
(four numbers a row) of one conversation, and never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

#: Rows between whose prices the auction runs at a time.
BLOCK = 16
#: Conversations of up to so many rows are looked up by the classes of their rows.
LONGEST_KEPT = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that a message of each role leads to from each state; others don't fit.
_FOLLOWS = {(_BEGIN, "s"): _SYSTEM, (_BEGIN, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
#: The role that a rerole or an insertion gives in each state.
NEXT_ROLE = ["user", "user", "assistant", "user"]
_FAR = 1 << 60


@lru_cache(maxsize=None)
def _arcs(row: str) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """Per state, the arcs (initial, cost, rows taken, next state) beside a row of a class, by initial.

    The class is the role's initial, in upper case for a truncated row, or ``x`` for a row that must go;
    the empty class stands for the end.
    """
    out = []
    for state in range(4):
        arcs = [("I", INSERT, 0, _FOLLOWS[state, NEXT_ROLE[state][0]])]
        if row:
            arcs.append(("D", DELETE, 1, state))
        if row and row != "x":
            more = TRUNCATED if row.isupper() else 0
            if (state, row.lower()) in _FOLLOWS:
                arcs.append(("K", KEEP + more, 1, _FOLLOWS[state, row.lower()]))
            arcs.append(("R", REROLE + more, 1, _FOLLOWS[state, NEXT_ROLE[state][0]]))
        out.append(tuple(sorted(arcs)))
    return tuple(out)


def _auction(rows: str, ends: list[int]) -> list[int]:
    """Prices of the nodes of a block, four before each row and four at its end; the first four are exact.

    ``ends`` are the exact prices of the last four. All begin at the least of them, so that what a block
    costs doesn't depend on what comes after it.
    """
    goal = 4 * len(rows) + 4
    arcs: list[list[tuple[int, int]]] = []
    for i, row in enumerate(rows):
        arcs += [[(cost, 4 * (i + taken) + to) for _, cost, taken, to in state] for state in _arcs(row)]
    arcs += [[(cost, goal)] for cost in ends]
    price = [min(ends)] * (4 * len(rows)) + [*ends, 0]
    for origin in range(4):
        path = [origin]
        while path[-1] != goal:
            node = path[-1]
            least, to = min([(cost + price[j], j) for cost, j in arcs[node]])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price[:goal]


def _trace(rows: str, price: list[int], state: int) -> tuple[str, int]:
    """The least initials along tight arcs from a state before a block to its end, and the state there."""
    end = 4 * len(rows)
    on: list[list[tuple[str, int]]] = [[] for _ in range(end)]
    leads = [False] * end + [True] * 4
    for i in range(len(rows) - 1, -1, -1):
        # Insertions stay before the row, at most two in a row, so three rounds settle its states.
        for _ in range(3):
            for s in range(4):
                k = 4 * i + s
                to = [(initial, cost, 4 * (i + taken) + t) for initial, cost, taken, t in _arcs(rows[i])[s]]
                on[k] = [(initial, j) for initial, cost, j in to if leads[j] and price[k] == cost + price[j]]
                leads[k] = bool(on[k])
    edits, k = [], state
    while k < end:
        initial, k = on[k][0]
        edits.append(initial)
    return "".join(edits), k - end


def _solve(rows: str) -> tuple[int, str]:
    blocks = [rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK)]
    # Nothing and a complete answer may end; a system message alone lacks two messages, a question one.
    ends = [0, 2 * INSERT, INSERT, 0]
    prices: list[list[int]] = []
    for block in reversed(blocks):
        prices.append(_auction(block, ends))
        ends = prices[-1][:4]
    edits, state = [], _BEGIN
    for block, price in zip(blocks, reversed(prices)):
        done, state = _trace(block, price, state)
        edits.append(done)
    edits.append({_SYSTEM: "II", _USER: "I"}.get(state, ""))
    return ends[_BEGIN], "".join(edits)


@lru_cache(maxsize=1 << 15)
def _solved(rows: str) -> tuple[int, str]:
    return _solve(rows)


def cheapest_edits(rows: str) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of rows of these classes; among several, the least initials."""
    return _solved(rows) if len(rows) <= LONGEST_KEPT else _solve(rows)


#: Order of a conversation's rows. Rows of one turn go by digest, so equal ones are neighbours.
_ORDER = ["conv_id", "turn", "digest"]
_AUDIT = pa.schema(
    [("conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
_AUDIT_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_SPACE = " \t\n\x0b\f\r"


def _rows(conversations: DataFrame) -> DataFrame:
    """Rows with a digest; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(spelled.cast("binary"), 256), 1, 32))
    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    return conversations.select(*ids, role.alias("role"), text.alias("text"), digest.alias("digest"))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = {"su", "ua", "au"}
    conv: object = batches  # no id is equal to it
    classes: list[str] = []
    out: list[tuple] = []

    def end() -> None:
        if conv is not batches:
            gaps = 0 if first is None else last - first + 1 - turns
            out.append((conv, (gaps + (1 << 63)) % (1 << 64) - (1 << 63), *faults, illegal, *cheapest_edits("".join(classes))))

    for batch in batches:
        for i, turn, digest, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if conv is batches or i != conv:
                end()
                conv, classes, seen, before = i, [], set(), None
                first = last = None
                turns = illegal = 0
                faults = [0, 0, 0]
            if digest is None:
                continue
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            if before is not None and before + initial not in legal:
                illegal += 1
            before = initial
            if fault != 1 and digest in seen:
                fault = 2
            seen.add(digest)
            if fault:
                faults[fault - 1] += 1
            classes.append("x" if fault in (1, 2) else initial.upper() if fault == 3 else initial)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _AUDIT)], schema=_AUDIT)
            out.clear()
    end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _AUDIT)], schema=_AUDIT)


def audit(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the least cost of a repair, and the repair's initials.

    Rows count by their first fault: blank, duplicate of an earlier row's role and text, truncated.
    Conversations of ``every`` without rows have zeros and no edits; so an empty table gives no rows.
    Null ids are one conversation; null turns come first and are in no gap; null roles and texts are one
    space. Columns beside conv_id, turn, role and text aren't looked at.
    """
    rows = _rows(conversations)
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.length(stripped) == 0, 1).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    reduced = rows.select(
        *_ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault")
    )
    if every is not None:
        ids = every.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
        reduced = reduced.unionByName(ids, allowMissingColumns=True)
    return reduced.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_audits, _AUDIT_DDL)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits, at, state, position, conv = "", 0, _BEGIN, 0, None
    out: list[tuple] = []
    size = 0

    def put(role: str, text: str) -> None:
        nonlocal state, position
        out.append((conv, position, role, text))
        state, position = _FOLLOWS[state, role[0]], position + 1

    def inserted() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            put(NEXT_ROLE[state], "")
            at += 1

    for batch in batches:
        for i, audited, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if audited is not None:
                inserted()
                edits, at, state, position, conv = audited, 0, _BEGIN, 0, i
                continue
            inserted()
            if edits[at] != "D":
                put(role if edits[at] == "K" else NEXT_ROLE[state], text)
                size += len(text)
            at += 1
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MESSAGES)], schema=_MESSAGES)
                size = out.clear() or 0
    inserted()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MESSAGES)], schema=_MESSAGES)


def repair(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired messages ``conv_id, position, role, text``, by the ``audit`` of the same rows.

    The messages of a conversation are together in a partition and in order.
    """
    rows = _rows(conversations).withColumn("audit", F.lit(None).cast("string"))
    # An audit has no digest and no turn; so it comes before the rows, also those of null turns.
    marks = audits.select("conv_id", "audit", F.lit(None).cast("bigint").alias("turn"))
    both = rows.unionByName(marks, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*_ORDER)
    messages = both.select("conv_id", "audit", "role", "text")
    return messages.mapInArrow(_apply, "conv_id bigint, position bigint, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, digest = None, None
    out: list[tuple] = []
    for batch in batches:
        for i, position, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            line = f"{role}:{text}".encode()
            if position:
                digest.update(b"\n" + line)
                continue
            if digest:
                out.append((conv, digest.hexdigest()))
            conv, digest = i, hashlib.sha256(line)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)


def digests(messages: DataFrame) -> DataFrame:
    """SHA-256 of the lines ``role:text`` of each conversation of ``repair``."""
    return messages.mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")


def audit_and_digest(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """``audit`` with the digest of the repaired messages."""
    audits = stored(audit(conversations, every), "repair-audits")
    found = digests(repair(conversations, audits)).withColumnRenamed("conv_id", "repaired_id")
    joined = audits.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").drop("repaired_id")
    empty = F.sha2(F.lit(b""), 256)
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` modulo 20 tells.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Nulls
    are one space, also in the checksum; ids and turns stay null.
    """
    space = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind: Column = F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    kind = F.col("kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
