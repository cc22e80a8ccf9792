import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import katz
from folioscope.llm.common import id_remainder


def brute(docs, held):
    """The model written out over dictionaries: a list of results, and a check that it is normalised."""
    texts = [(t or "").encode().lower().split() + [None] for _, t in docs]
    words, pairs, times, after = Counter(), Counter(), Counter(), defaultdict(Counter)
    for tokens, out in zip(texts, held):
        if not out:
            words.update(tokens)
            for a, b in zip(["start", *tokens], tokens):
                after[a][b] += 1
                times[a] += 1
    pairs = Counter({(a, b): c for a, f in after.items() for b, c in f.items()})
    n, v = sum(words.values()), len(words)
    d1, d2 = (katz.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in (words, pairs))
    left = sum((1 - d1[c - 1]) * c for c in words.values() if c <= 5)

    def p(w):
        c = words[w]
        if left <= 0:
            return (c + 1) / (n + v + 1)
        return ((d1[c - 1] if c <= 5 else 1) * c if c else left) / n

    def seen(a, c):
        most = times[a] + all(x > 5 for x in after[a].values())
        return (d2[c - 1] if c <= 5 else 1) * c / most

    weight = {a: (1 - sum(seen(a, c) for c in f.values())) / (1 - sum(map(p, f))) for a, f in after.items()}
    for a, f in list(after.items())[:50]:
        others = [w for w in words if w not in f]
        total = sum(seen(a, c) for c in f.values()) + weight[a] * (sum(map(p, others)) + p("not a word"))
        assert abs(total - 1) < 1e-9
    out = []
    for (i, _), tokens, h in zip(docs, texts, held):
        score = 0.0
        for a, b in zip(["start", *tokens], tokens):
            c = after[a][b] if a in after else 0
            score += math.log10(seen(a, c) if c else weight.get(a, 1) * p(b))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, h, len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    return out


def compare(df, docs, **sizes):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in docs]
    wanted = brute(docs, held)
    found = [tuple(r) for r in katz.scores(df, id_remainder(F.col("doc_id"), 7) == 2, **sizes).collect()]
    order = lambda r: (str(r[0]), r[2], r[5])
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=order), sorted(wanted, key=order)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 300, "part_tokens": 2000, "hot_share": 2}])
def test_scores_are_the_model_written_out(documents, clashing, sizes):
    draw = random.Random(4)
    vocabulary = [f"w{int(draw.paretovariate(0.8)) % 300}" for _ in range(2000)]
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n\t"), (503, "UPPER upper É é"), (None, "no id w1 w2"), (7, docs[7][1])]
    docs += [(504, "the the " * 3000)]
    compare(clashing(documents(docs)), docs, **sizes)


def test_hot_history_is_spread(documents):
    draw = random.Random(9)
    docs = [(i, " ".join(f"the x{draw.randint(0, 400)}" for _ in range(100))) for i in range(60)]
    compare(documents(docs), docs, part_tokens=1000, block_tokens=2000, hot_share=8)


def test_spread_histories_of_large_counts_only(documents):
    """No pair after "the" is discounted, in any partition, or only in one of them."""
    docs = [(i, " ".join(f"the x{j % 7}" for j in range(70))) for i in range(30)]
    for more in ([], [(100, "the rare")]):
        for sizes in ({}, {"part_tokens": 500, "block_tokens": 2000, "hot_share": 8}):
            compare(documents(docs + more), docs + more, **sizes)


def test_nothing_learned_and_no_documents(documents):
    rows = katz.scores(documents([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [
        (1, 3, 0, 0, 0.0, 0.0),
        (2, 1, 0, 0, 0.0, 0.0),
    ]
    assert katz.scores(documents([]), F.lit(False)).collect() == []


def test_only_repeated_counts(documents):
    """Nothing is discounted where all counts are large: a history then counts once more."""
    docs = [(i, "a b") for i in range(40)] + [(2, "a c"), (1, "b a")]
    compare(documents(docs), docs)


def test_held_out_text_is_better_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = katz.scores(docs, id_remainder(F.col("doc_id"), 7) == 2).filter("held_out").agg(F.sum("base_score"), F.sum("score"))
    base, score = sums.collect()[0]
    assert score > base
