import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioscope.llm import trie
from folioscope.llm.queries import QUERIES

COLUMNS = "conv_id bigint, turn bigint, role string, text string, path string, kind string, shard string, end_key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], COLUMNS).repartition(3)


def order(turn):
    return float("-inf") if turn is None else turn


def brute(rows):
    """The nodes of rebuilt conversations, each counted on its own."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: order(r[1])):
        own[conv].append((role or "", text or ""))
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in convs if rebuilt[c] == node)
        out.append(
            (
                convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]),
                sum(not children[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(spark, rows):
    df = trie.rebuilt_trie(frame(spark, rows), lambda c: trie.F.crc32(c.cast("string").cast("binary")) % 9)
    assert df.columns == [*trie.NODE_COLUMNS, "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def some(seed, convs, most):
    random.seed(seed)
    rows = []
    for conv in range(convs):
        if random.random() < 0.1:
            continue
        for turn in range(random.randrange(1, most)):
            rows.append((conv, turn if turn else None, random.choice("uuusa"), random.choice(["x", "x", "yé", "", None])))
    return rows


@pytest.mark.parametrize("turns", [1, 7, 1 << 18])
def test_nodes_against_counting(spark, monkeypatch, turns):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(trie, "CHUNK_BYTES", 60)
    rows = some(1, 40, 14)
    # Copies of one conversation, a chain of prefixes, and a common first turn.
    rows += [(conv, turn, "u", f"t{turn}") for conv in range(50, 90) for turn in range(3)]
    rows += [(conv, turn, "u", "same") for conv in range(100, 130) for turn in range(conv - 99)]
    rows += [(conv, turn, "u", "first" if turn < 9 else str(conv)) for conv in range(200, 220) for turn in range(11)]
    assert found(spark, rows) == brute(rows)


def test_long_conversations_and_hard_rows(spark):
    long = "word " * 20000
    rows = [(conv, turn, "u", long if turn == 3 else "") for conv in (5, 6, 7, 11) for turn in range(500)]
    rows += [(-7, 2, None, None), (-7, None, "s", ""), (-5, 1, "", None), (None, 1, "u", "no conversation"), (2**62, 1, "u", "far")]
    rows += [(40, 1, "u", "again"), (40, 1, "u", "again"), (41, 8, "u", "own")]
    got = found(spark, rows)
    # A remainder has the sign of its id, as in SQL, so -7 takes the first turns of -5; all others are below the root alike.
    assert {r[0] for r in got if r[1] == 0} == {-7}
    others = brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert [r for r in got if r[0] >= 0 and r[1] > 1] == [r for r in others if r[1] > 1]


def test_empty_table(spark):
    assert found(spark, [(1, 1, "u", "x")])
    empty = frame(spark, [(1, 1, "u", "x")]).filter("false")
    assert trie.rebuilt_trie(empty, lambda c: c % 9).collect() == []


def test_closing_parentheses_far_away():
    random.seed(4)
    for _ in range(200):
        marks, depth = [], 0
        while len(marks) < random.choice([2, 70, 3000]) or depth:
            up = not depth or (len(marks) < 3000 and random.random() < random.choice([0.3, 0.5, 0.9]))
            marks.append(up)
            depth += 1 if up else -1
            if len(marks) > 6000 and not depth:
                break
        stack, close = [], {}
        for i, up in enumerate(marks):
            if up:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = trie.Parentheses(np.array(marks))
        at = np.flatnonzero(marks)
        assert tree.findclose(at).tolist() == [close[i] for i in at]


def test_query_without_cuts_equals_query_with_many(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    monkeypatch.setattr(trie, "SHARD_TURNS", 16)
    cut = sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert whole == cut
