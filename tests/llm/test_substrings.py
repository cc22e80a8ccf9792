import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import substrings


def brute(docs, length):
    raws = [(t or "").encode() for _, t in docs]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(docs, raws):
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if counts[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for p in range(len(r)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(df, docs, length, **more):
    found = [(*tuple(r)[:5], bytes(r.kept)) for r in substrings.remove_repeats(df, length=length, **more).collect()]
    assert sorted(found, key=str) == sorted(brute(docs, length), key=str)


SOME = "the common passage that many documents hold, word by word, é included; "


def corpus():
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    docs = [(i, text(draw.randint(0, 150))) for i in range(20)]
    docs += [(100 + i, text(draw.randint(0, 30)) + SOME + text(draw.randint(0, 30))) for i in range(30)]
    docs += [(200, "ab" * 100), (201, "a" * 90), (202, "a" * 90), (203, text(60) * 2), (204, None), (205, ""), (206, "short")]
    docs += [(300, docs[3][1]), (None, docs[25][1]), (7, docs[7][1]), (7, docs[7][1]), (301, text(20_000)), (302, SOME * 300)]
    near = text(400)
    docs += [(400 + i, near[: 37 * i] + "X" + near[37 * i :]) for i in range(10)]
    return docs


@pytest.mark.parametrize("largest_group", [substrings.LARGEST_GROUP, 2])
def test_repeats_by_definition(documents, clashing, largest_group):
    check(clashing(documents(corpus())), corpus(), 24, grams=(8, 18, 24), largest_group=largest_group)


def test_production_sizes(documents):
    docs = [(i, (t or "") * 3) for i, t in corpus()[:60]]
    check(documents(docs), docs, substrings.LENGTH)


def test_no_documents(documents):
    assert substrings.remove_repeats(documents([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12, unique=True),
       st.integers(1, 12), st.data())
def test_intervals_are_the_repeated_strings(segments, length, data):
    counts = [data.draw(st.integers(1, 2)) for _ in segments]
    strings = Counter()
    for s, c in zip(segments, counts):
        for p in range(len(s) - length + 1):
            strings[s[p : p + length]] += c
    for s, (firsts, lasts) in zip(segments, substrings.repeated_strings(segments, counts, length)):
        starts = {p for a, b in zip(firsts, lasts) for p in range(a, b + 1)}
        assert starts == {p for p in range(len(s) - length + 1) if strings[s[p : p + length]] > 1}


@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(values):
    import numpy as np

    symbols = np.array([*values, 0], np.uint16)
    n = len(symbols)
    assert substrings.suffix_array(symbols).tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())


@given(st.binary(max_size=300).map(lambda b: bytes(x % 2 for x in b)), st.sampled_from([(3, 8), (8, 8), (5, 20)]))
def test_runs_cover_every_string_once_and_equal_strings_share_keys(raw, sizes):
    gram, length = sizes
    keys, starts, lengths, anchors = substrings.Keys(gram, length).runs(raw)
    found = {p: k for k, s, m in zip(keys, starts, lengths) for p in range(s, s + m)}
    assert sorted(found) == list(range(max(0, len(raw) - length + 1)))
    of = {}
    for p, k in found.items():
        assert of.setdefault(raw[p : p + length], k) == k
    for k, s, m, a in zip(keys, starts, lengths, anchors):
        inside = [raw[p : p + length] for p in range(s, s + m)]
        assert a >= 1 and (a > 1 or len(set(inside)) == len(inside))
