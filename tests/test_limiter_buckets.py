"""The live limiter over many keys: they share the entries of the state store."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.streaming import limiter

SCHEMA = "key string, at timestamp, event_id long, success boolean"


def test_entries_and_timers_do_not_follow_the_keys(spark, rows, tmp_path):
    """2,000 keys fail in turn for 25 minutes; the watermarks fall into the middle of minutes and windows."""
    random.seed(7)
    start = dt.datetime(2026, 1, 1)
    data = [(f"k{random.randrange(2000)}", start + dt.timedelta(seconds=i * 0.25, microseconds=i % 7), i, i % 9 == 0) for i in range(6000)]
    clock = [("clock", start + dt.timedelta(days=1), -1, True)]
    folder = str(tmp_path)
    opened = limiter.open_windows(spark.createDataFrame(data[:2000], SCHEMA))
    entries = []
    for part in (data[2000:4130], data[4130:] + clock):
        spark.createDataFrame(random.sample(part, len(part)), SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        query = (
            limiter.live_limiter(stream, opened).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        entries += [p["stateOperators"][0] for p in query.recentProgress]
    columns = ("key", "event_id", "window_start", "failures", "limited")
    whole = limiter.limiter(spark.createDataFrame(data, SCHEMA)).filter(F.col("event_id") >= 2000)
    assert rows(spark.read.parquet(f"{folder}/out"), *columns) == rows(whole, *columns)
    # Timers are followed by four updates of a bucket at most, where they were followed by one for each key.
    timers = [e["numRowsUpdated"] for e in entries[1::2]]
    assert max(timers) <= 4 * 128, timers
    assert entries[-1]["numRowsTotal"] <= 4


def _walk(events):
    found, state = [], {}
    for key, at, event_id, success in sorted(events, key=lambda e: (e[1], e[2])):
        start, failures = state.get(key, (None, 0))
        if success:
            state[key] = (None, 0)
            continue
        if start is None or at - start >= limiter.WINDOW_SECONDS * 10**6:
            start, failures = at, 0
        state[key] = (start, failures + 1)
        found.append((key, at, event_id, start, failures + 1, failures + 1 >= limiter.LIMIT))
    return sorted(found, key=lambda f: f[2])


def test_stretches_in_turn_equal_one_walk():
    """Ends of windows on the microsecond, rows at one moment, keys that are null, stretches of any length."""
    for seed in range(60):
        rand, at, events = random.Random(seed), 0, []
        for i in range(rand.choice([3, 50, 300])):
            gaps = [0, 1, 10**6, 5 * 10**6]
            at += rand.choice(gaps if rand.random() < 0.7 else [4 * 10**7, 2 * 10**8, 9 * 10**8 - 1, 9 * 10**8, 9 * 10**8 + 1])
            events.append((rand.choice(["a", "b", "c", None]), at, i, rand.random() < 0.1))
        slots = {}
        for event in rand.sample(events, len(events)):
            slots.setdefault(event[1] // (limiter.SLOT_SECONDS * 10**6), []).append(event)
        due, windows, found = sorted(slots), limiter._WINDOWS.empty_table(), []
        while due:
            begin, part, many = due[0], [], rand.choice([1, 20, 1000])
            while due and due[0] - begin < limiter._WINDOW_SLOTS and len(part) < many:
                part += slots[due.pop(0)]
            packed = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), limiter._ROWS.types)], schema=limiter._ROWS)
            rows = pa.Table.from_batches([limiter._unpacked(limiter._packed(pa.Table.from_batches([packed])), limiter._ROWS)])
            out, windows = limiter._count_stretch(rows, limiter._still_open(windows, begin))
            micros = [out[c].astype("int64") if c in ("at", "window_start") else out[c] for c in out]
            found += zip(*(c.tolist() for c in micros))
        assert sorted(found, key=lambda f: f[2]) == _walk(events), seed
