import hashlib
import random
import re

import pytest

from folioscope.llm import decontaminate


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    sought = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            sought.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in sought}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if (ids := sought.get(tuple(w[at : at + size]))) is not None:
                    hit.update(range(at, at + size))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def check(spark, docs, df, items, **sizes):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, gram string, window string")
    found = [tuple(r)[:6] for r in decontaminate.contamination(df, frame, **sizes).collect()]
    assert sorted(found, key=str) == sorted(brute(docs, items, sizes.get("window", 10)), key=str)


@pytest.mark.parametrize("sizes", [{}, {"window": 4, "gram": 2}, {"window": 5, "gram": 5}])
def test_hits_by_definition(spark, documents, clashing, sizes):
    draw = random.Random(2)
    vocabulary = ["the", "of", "Ünder", "x1", "and", "É", "blue", "cat"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randint(0, 25))) for i in range(25)] + [(100, None), (None, text(12)), (3, "the cat"), (4, "zebra")]
    items += [(101, "of " * 40), (102, items[0][1]), (103, "!!!")]
    docs = [(i, text(draw.randint(0, 80))) for i in range(40)] + [(200, None), (201, ""), (202, "A-B_C ÀÉß 日本")]
    docs += [(300 + i, text(8) + " " + (items[i][1] or "") + " " + text(9)) for i in range(25)]
    docs += [(400, "of " * 3000), (None, items[5][1]), (7, docs[7][1]), (401, (items[6][1] or "").upper())]
    check(spark, docs, clashing(documents(docs)), items, **sizes)


def test_single_word_items(spark, documents):
    docs = [(1, "a b a"), (2, "b"), (3, None)]
    check(spark, docs, documents(docs), [(1, "a"), (2, "A!"), (10, "b a b")])


def test_empty_tables(spark, documents):
    check(spark, [(1, "some words")], documents([(1, "some words")]), [])
    check(spark, [(1, "some words")], documents([(1, "some words")]), [(5, None)])
    check(spark, [], documents([]), [(1, "a b c")])


def test_joined_by_hash_beyond_the_bound(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"start {i} {passage} end") for i in range(50)] + [(60, "clean text of words")]
    check(spark, docs, documents(docs), [(1, passage), (2, "other words that occur in no text at all here ok")])


def test_main_path_has_no_python(spark, documents):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    df = decontaminate.contamination(documents([(1, "a b c d e f g")]), items)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
