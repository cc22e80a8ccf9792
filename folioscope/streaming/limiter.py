"""Failure limiter: a window opens at the first failure of a key, not at fixed times.

Failures are counted from the first one on; the first failure a quarter of an hour after the start
or later opens a new window, a success clears it, and five failures in a window limit the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Length of a window and failures that limit a key.
WINDOW_SECONDS = 15 * 60
LIMIT = 5

OUTPUT = "key string, at timestamp, event_id bigint, window_start timestamp, failures int, limited boolean"
_MICROS = 1_000_000


def with_segments(events: DataFrame) -> DataFrame:
    """Adds ``segment``: stretches of a key that cannot share a window.

    A failure at least one window length after the one before it always opens a new window, and a
    success clears everything before it, so the key can be cut at both. Slots of one window length
    stand in for their events: a slot starts a segment after a gap, and another one behind its last
    success; the window function sees slots only, never a key's whole event list.
    """
    slot = F.floor(F.unix_micros("at") / F.lit(WINDOW_SECONDS * _MICROS)).alias("slot")
    slotted = events.withColumn("slot", slot)
    moment = F.struct("at", "event_id")
    bounds = slotted.groupBy("key", "slot").agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"), F.max(F.when(F.col("success"), moment)).alias("_cleared")
    )
    order = Window.partitionBy("key").orderBy("slot")
    gap = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(order))
    opens = F.coalesce(gap >= WINDOW_SECONDS * _MICROS, F.lit(True))
    head, tail = 2 * F.col("slot"), 2 * F.col("slot") + 1
    marked = (
        bounds.withColumn("_opens", F.when(opens, head))
        .withColumn("_mark", F.when(F.col("_cleared").isNotNull(), tail).otherwise(F.col("_opens")))
        .withColumn("_after", F.last("_mark", ignorenulls=True).over(order))
        .withColumn("_before", F.coalesce("_opens", F.lag("_after").over(order)))
    )
    behind = F.coalesce(moment > F.col("_cleared"), F.lit(True))
    joined = slotted.join(marked.select("key", "slot", "_before", "_after", "_cleared"), ["key", "slot"])
    return joined.withColumn("segment", F.when(behind, F.col("_after")).otherwise(F.col("_before"))).drop(
        "slot", "_before", "_after", "_cleared"
    )


def _count_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over rows sorted by (key, segment, at); only the open window is remembered."""
    current = None
    start, failures = None, 0
    for batch in batches:
        starts, counts = [], []
        for key, segment, at, success in zip(batch["key"], batch["segment"], batch["at"], batch["success"]):
            if (key, segment) != current:
                current, start, failures = (key, segment), None, 0
            if success:
                start, failures = None, 0
            elif start is None or (at - start).total_seconds() >= WINDOW_SECONDS:
                start, failures = at, 1
            else:
                failures += 1
            starts.append(start)
            counts.append(failures)
        out = batch[["key", "at", "event_id"]].copy()
        out["window_start"] = pd.Series(starts, index=out.index, dtype=batch["at"].dtype)
        out["failures"] = counts
        out["limited"] = [n >= LIMIT for n in counts]
        yield out[~batch["success"].to_numpy(dtype=bool)]


def limiter(events: DataFrame) -> DataFrame:
    """State of the limiter after every failure; ``events`` has key, at, event_id and success.

    Work is spread by (key, segment) and streams through sorted partitions with constant memory. A key
    with a third of all events fills one task only as far as it fails without a success and without a
    quarter of an hour's rest, since there each window depends on the one before.
    """
    placed = with_segments(events).select("key", "segment", "at", "event_id", "success")
    ordered = placed.repartition("key", "segment").sortWithinPartitions("key", "segment", "at", "event_id")
    return ordered.mapInPandas(_count_windows, OUTPUT)


def open_windows(events: DataFrame) -> DataFrame:
    """key, start (microseconds) and failures of every window that is open after the last event of its key."""
    moment = F.struct("at", "event_id")
    last = events.groupBy("key").agg(F.max(moment).alias("_last")).select("key", "_last.at", "_last.event_id")
    return limiter(events).join(last, ["key", "at", "event_id"], "left_semi").select(
        "key", F.unix_micros("window_start").alias("start"), "failures"
    )


#: Rows wait for the watermark by slots of this length; a window is a whole number of them.
SLOT_SECONDS = 60
#: Slots are kept together while they have fewer rows than this, and counted together while fewer than that.
PART_ROWS = 1_000
STRETCH_ROWS = 10_000
#: Keys are dealt to so many buckets, whose rows and windows share their entries in the state store.
BUCKETS = 128

_SLOT_MILLIS = SLOT_SECONDS * 1000
_WINDOW_SLOTS = WINDOW_SECONDS // SLOT_SECONDS


class _Limiter(StatefulProcessor):
    """Rows of a bucket wait in the state store, packed by slots; a timer has the slots counted in order that are over.

    A call of the store or of a timer costs about a millisecond, whatever it carries, so each serves all keys of
    a bucket. A bucket has one timer: its first slot's end, or at rest the time when no window is open any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "windows binary")
        self._parts = handle.getValueState("parts", "listed binary, timer bigint")
        self._waiting = handle.getMapState("waiting", "part bigint", "rows binary")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        handed = pa.RecordBatch.from_pandas(initialState[_WINDOWS.names], _WINDOWS, preserve_index=False)
        windows = pa.Table.from_batches([*self._windows().to_batches(), handed])
        self._remember(windows)
        self._sleep(*self._listed(), windows)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts, timer = self._listed()
        for batch in rows:
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            columns = (batch["key"], micros, batch["event_id"], batch["success"].to_numpy("bool"))
            self._wait(pa.table([pa.array(c, t) for c, t in zip(columns, _ROWS.types)], schema=_ROWS), parts)
        self._sleep(parts, timer)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = max(now, timerValues.getCurrentWatermarkInMs()) // _SLOT_MILLIS
        parts, timer = self._listed()
        parts.sort(reverse=True)
        windows, held, states = self._windows(), _ROWS.empty_table(), []
        while parts or len(held):
            begin = int(_slots(held).min(initial=parts[-1][0] if parts else np.iinfo("int64").max))
            if begin >= over:
                break
            until = min(begin + _WINDOW_SLOTS, over)
            while parts and parts[-1][0] < until:
                if len(held) >= STRETCH_ROWS and parts[-1][0] > begin:
                    until = parts[-1][0]
                    break
                part = (parts.pop()[1],)
                held = pa.Table.from_batches([*held.to_batches(), _unpacked(self._waiting.getValue(part)[0], _ROWS)])
                self._waiting.removeKey(part)
            due = _slots(held) < until
            out, windows = _count_stretch(held.filter(pa.array(due)), windows)
            windows, held = _still_open(windows, until), held.filter(pa.array(~due))
            states.append(out)
            if sum(map(len, states)) >= STRETCH_ROWS:
                yield pd.concat(states)
                states.clear()
        if states:
            yield pd.concat(states)
        self._wait(held, parts)
        windows = _still_open(windows, over)
        self._remember(windows)
        self._sleep(parts, None if timer == now else timer, windows)

    def _windows(self) -> pa.Table:
        found = self._open.get()
        return pa.Table.from_batches([_unpacked(found[0], _WINDOWS)] if found else [], _WINDOWS)

    def _remember(self, windows: pa.Table) -> None:
        if len(windows):
            self._open.update((_packed(windows),))
        else:
            self._open.clear()

    def _listed(self) -> tuple[list[list[int]], int | None]:
        """First slot and number of every part that waits, and the timer that is set."""
        found = self._parts.get()
        return (np.frombuffer(found[0], "<i8").reshape(-1, 2).tolist(), found[1]) if found else ([], None)

    def _wait(self, rows: pa.Table, parts: list[list[int]]) -> None:
        """Puts rows away once, however many come later: a part is a slot, or several with few rows."""
        slots = _slots(rows)
        order = np.argsort(slots, kind="stable")
        rows = rows.take(pa.array(order))
        cuts = []
        for slot, begin in zip(*(a.tolist() for a in np.unique(slots[order], return_index=True))):
            if not cuts or begin - cuts[-1][1] >= PART_ROWS or slot - cuts[-1][0] >= _WINDOW_SLOTS:
                cuts.append((slot, begin))
        number = max((part for _, part in parts), default=-1)
        for (slot, begin), end in zip(cuts, [*(begin for _, begin in cuts[1:]), len(rows)]):
            number += 1
            self._waiting.updateValue((number,), (_packed(rows.slice(begin, end - begin)),))
            parts.append([slot, number])

    def _sleep(self, parts: list[list[int]], timer: int | None, windows: pa.Table | None = None) -> None:
        wake = timer
        if parts:
            wake = (min(parts)[0] + 1) * _SLOT_MILLIS
        elif windows:
            # Behind the slot that holds the end of the newest window.
            wake = pc.max(windows["start"]).as_py() // 1000 + WINDOW_SECONDS * 1000 + 1 + _SLOT_MILLIS
        if wake is None:
            self._parts.clear()
            return
        if timer is None or wake < timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(wake)
            timer = wake
        self._parts.update((np.array(parts, "<i8").tobytes(), timer))

    def close(self) -> None:
        pass


_ROWS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("success", pa.bool_())])
_WINDOWS = pa.schema([("key", pa.string()), ("start", pa.int64()), ("failures", pa.int32())])


def _slots(rows: pa.Table) -> np.ndarray:
    return rows["at"].to_numpy() // (SLOT_SECONDS * _MICROS)


def _packed(rows: pa.Table) -> bytes:
    return rows.combine_chunks().to_batches()[0].serialize().to_pybytes()


def _unpacked(packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(packed), schema)


def _still_open(windows: pa.Table, slot: int) -> pa.Table:
    """Those that a row of the slot or of a later one may fall into."""
    ends = pc.add(windows["start"], WINDOW_SECONDS * _MICROS)
    return windows.filter(pc.greater(ends, slot * SLOT_SECONDS * _MICROS))


def _count_stretch(rows: pa.Table, windows: pa.Table) -> tuple[pd.DataFrame, pa.Table]:
    """The state after each failure of a stretch, and the windows open behind it; ``windows`` are those open before.

    A stretch is no longer than a window, so a window that opens in it ends in it only by a success.
    """
    length = WINDOW_SECONDS * _MICROS
    keys = pa.chunked_array([*windows["key"].chunks, *rows["key"].chunks]).combine_chunks().dictionary_encode("encode")
    codes = keys.indices.to_numpy()
    here, codes = codes[: len(windows)], codes[len(windows) :]
    n = len(keys.dictionary)
    is_open, start, failures = np.zeros(n, "bool"), np.zeros(n, "int64"), np.zeros(n, "int64")
    is_open[here], start[here], failures[here] = True, windows["start"].to_numpy(), windows["failures"].to_numpy()

    at, success, known = rows["at"].to_numpy(), rows["success"].to_numpy(), rows["event_id"].fill_null(-(2**63)).to_numpy()
    order = np.lexsort((known, at, codes))
    code, at, success, event_id = codes[order], at[order], success[order], rows["event_id"].take(pa.array(order))
    index = np.arange(len(code))
    first = np.ones(len(code), "bool")
    first[1:] = code[1:] != code[:-1]
    # The window from before lasts up to a success, or to the first row a window's length behind its start.
    cleared = np.cumsum(success) - success
    cleared -= cleared[np.maximum.accumulate(np.where(first, index, 0))]
    carried = is_open[code] & (at < start[code] + length) & (cleared == 0)
    opens = first.copy()
    opens[1:] |= success[:-1] | (carried[:-1] & ~carried[1:])
    head = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    window_start = np.where(carried[head], start[code[head]], at[head])[run]
    counts = np.where(carried[head], failures[code[head]], 0)[run] + index - head[run] + 1

    last = np.append(first[1:], True)
    is_open[code[last]], start[code[last]], failures[code[last]] = ~success[last], window_start[last], counts[last]
    left = np.flatnonzero(is_open)
    behind = pa.table([keys.dictionary.take(left), start[left], failures[left].astype("int32")], schema=_WINDOWS)

    failed = np.flatnonzero(~success)
    out = pd.DataFrame({
        "key": keys.dictionary.take(pa.array(code[failed])).to_pandas(), "at": at[failed].astype("datetime64[us]"),
        "event_id": event_id.take(pa.array(failed)).to_pandas(),
        "window_start": window_start[failed].astype("datetime64[us]"), "failures": counts[failed].astype("int32"),
        "limited": counts[failed] >= LIMIT,
    })
    return out, behind


def live_limiter(stream: DataFrame, opened: DataFrame | None = None, late: str = "1 minute") -> DataFrame:
    """The limiter over a stream of key, at, event_id and success, in order of time.

    A failure comes out once the watermark, ``late`` behind the newest event, has passed its slot of a
    minute; rows later than that are dropped. ``opened``, as ``open_windows`` gives it, is where earlier
    events left the keys. State and waiting rows are in the state store; a task holds the rows of one bucket
    of keys and minute, those of its quarter of an hour where they are few, and the windows open in it. The query needs the RocksDB store: start it
    inside ``session.state_in_rocksdb``. A checkpoint is bound to ``BUCKETS``.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    rows = stream.select(bucket, "key", "at", "event_id", "success").withWatermark("at", late)
    first = None if opened is None else opened.select(bucket, "key", "start", "failures").groupBy("bucket")
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Limiter(), OUTPUT, "Append", "EventTime", first
    )
