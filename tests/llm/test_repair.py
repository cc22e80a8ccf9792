import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from folioscope.llm import repair

COLUMNS = "conv_id bigint, turn bigint, role string, text string, digest string, audit string, kind string, pos string"
BLANK = re.compile(r"[ \t-\r]*")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], COLUMNS).repartition(3)


def cheapest(classes):
    """Least (cost, initials) by searching all paths in order of both."""
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, edits, i, before, _ = heapq.heappop(heap)
        if i == len(classes) and before in ("", "a"):
            return cost, edits
        if (i, before) in done:
            continue
        done.add((i, before))
        after = "a" if before == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", i, after, ""))
        if i < len(classes):
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, before, ""))
            c = classes[i]
            if c != "x":
                more = 5 if c.isupper() else 0
                if c.lower() == after or (c.lower() == "s" and before == ""):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, c.lower(), ""))
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, after, ""))


@pytest.mark.parametrize("block", [1, 2, 3, 16])
def test_edits_are_the_cheapest_and_least(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    random.seed(block)
    for letters in ("ua", "suaSUAxoO", "xU", "s", "suaua"):
        for _ in range(150):
            classes = "".join(random.choices(letters, k=random.randrange(14)))
            assert repair._solve(classes) == cheapest(classes)


def test_long_conversations_take_time_in_proportion():
    assert repair.cheapest_edits("sU" * 20000) == (60000, "DDKD" + "RD" * 19998)
    assert repair.cheapest_edits("ua" * 20000) == (0, "K" * 40000)


def brute(rows):
    """Results of every conversation after damage."""
    live = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            live[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, found in live.items():
        found = [r for _, r in sorted(enumerate(found), key=lambda r: (float("-inf") if r[1][0] is None else r[1][0], r[0]))]
        turns = [t for t, _, _ in found if t is not None]
        faults, seen, classes = defaultdict(int), set(), ""
        for _, role, text in found:
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            last = text.rstrip(" \t\n\r\v\f")[-1:]
            fault = "blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            classes += {"": initial, "truncated": initial.upper()}.get(fault, "x")
        cost, edits = cheapest(classes)
        lines, rest = [], [(role, text) for _, role, text in found]
        for e in edits:
            role, text = ("", "") if e == "I" else rest.pop(0)
            system = bool(lines) and lines[0].startswith("s")
            given = "assistant" if (len(lines) - system) % 2 else "user"
            if e != "D":
                lines.append(f"{role if e == 'K' else given}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    df = frame(spark, rows)
    return sorted(map(tuple, repair.audit_and_digest(repair.damage(df), df).collect()), key=repr)


def test_audits_and_messages(spark):
    random.seed(9)
    rows = []
    for conv in range(120):
        for turn in range(random.randrange(1, 12)):
            role = random.choice(["user", "assistant", "assistant", "user", "system", "s", "", "tool", None, "User"])
            rows.append((conv, turn * random.choice([1, 1, 2]) or None, role, random.choice(["a.", "b!", "c? \n", "d", "", " \t\r\x0b", "é…", None, " "])))
    # One row per turn, as the order of different rows of one turn isn't the brute force's.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert found(spark, rows) == brute(rows)


def test_null_ids_dropped_rows_long_and_repeated_rows(spark):
    dropped = [c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    rows = [(c, 0, "user", "all go.") for c in dropped]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, None, None)]
    rows += [(-4, turn, "user" if turn % 2 else "assistant", f"{turn}." + "long. " * 20000) for turn in range(300)]
    rows += [(8, 1, "user", "same.")] * 3 + [(8, 2, "assistant", "end.")]
    rows += [(9, -(2**62), "user", "a."), (9, 2**62, "assistant", "b.")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert [r for r in got if r[0] in dropped] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped]


def test_repaired_messages_are_rows(spark):
    df = frame(spark, [(1, 1, "assistant", "b."), (1, 2, "assistant", "c."), (2, 1, "system", "s."), (2, 2, "user", "q?")])
    audits = repair.audit(df)
    assert sorted((r.conv_id, r.cost, r.audit) for r in audits.collect()) == [(1, 1, "RK"), (2, 2, "RR")]
    assert sorted(map(tuple, repair.repair(df, audits).collect())) == [
        (1, 0, "user", "b."), (1, 1, "assistant", "c."), (2, 0, "user", "s."), (2, 1, "assistant", "q?")
    ]


def test_empty_table(spark):
    empty = frame(spark, [(1, 1, "user", "x")]).filter("false")
    assert repair.audit_and_digest(repair.damage(empty), empty).collect() == []
