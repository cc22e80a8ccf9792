import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import lines


def brute(docs, run):
    """doc_id, text -> what stays, by the definition: windows of ``run`` lines with an earlier place go."""
    parts = {}
    for i, text in docs:
        parts[i, text] = [" ".join(p.decode() for p in x.encode().split()) for x in (text or "").split("\n")]
    first = {}
    for (i, text), all_lines in sorted(parts.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        filled = [x for x in all_lines if x]
        for at in range(len(filled) - run + 1):
            first.setdefault(tuple(filled[at : at + run]), (i, text, at))
    out = {}
    for (i, text), all_lines in parts.items():
        filled = [x for x in all_lines if x]
        gone = {
            at + k
            for at in range(len(filled) - run + 1)
            if first[tuple(filled[at : at + run])] != (i, text, at)
            for k in range(run)
        }
        kept, at = [], -1
        for raw, line in zip((text or "").split("\n"), all_lines):
            at += bool(line)
            if at not in gone:
                kept.append(raw)
        out[i, text] = (None if text is None else "\n".join(kept), len(filled), len(gone))
    return out


def check(df, docs, run):
    wanted = brute(docs, run)
    rows = lines.dedup_lines(df, run=run).select("row.doc_id", "row.text", "lines.*").toDF("i", "was", "text", "n", "gone").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.text, r.n, r.gone) == wanted[r.i, r.was], r.i


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_repeated_runs_go(documents, clashing, run):
    draw = random.Random(run)
    docs = [(i, "\n".join(draw.choice(["a", "b", " a ", "", "c  d", "c d", "é"]) for _ in range(draw.randint(0, 25)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, "a\nb\nc d\na"), (103, "same\n" * 500), (5, docs[5][1])]
    docs += [(104, "\n".join(str(k) for k in range(3000))), (105, "x\n" + "\n".join(str(k) for k in range(1000, 2000)) + "\ny")]
    check(clashing(documents(docs)), docs, run)


def test_common_line_in_many_contexts_stays(documents):
    docs = [(i, f"own {i}\ncommon\nlast {i}") for i in range(200)]
    check(documents(docs), docs, lines.RUN)


def test_no_documents(documents):
    assert lines.dedup_lines(documents([])).collect() == []


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_every_window_has_its_selected_line(values, run):
    import numpy as np

    found = lines.winnow(np.array(values, np.int64), run)
    windows = [start for _, first, last in found for start in range(first, last + 1)]
    assert windows == list(range(max(0, len(values) - run + 1)))
    for at, first, last in found:
        assert all(start <= at < start + run and values[at] == min(values[start : start + run]) for start in range(first, last + 1))


def long_line(seed, words=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(words))


def brute_large(docs, run):
    """doc_id, text -> what stays: windows of ``run`` lines, and shorter ones of 50 words or 300 bytes, go."""
    filled = {(i, t): [" ".join(x.decode() for x in p.encode().split()) for p in (t or "").split("\n") if p.strip()] for i, t in docs}
    def windows(all_lines):
        for n in range(1, run + 1):
            for at in range(len(all_lines) - n + 1):
                w = all_lines[at : at + n]
                if n == run or sum(len(x.split()) for x in w) >= 50 or sum(len(x.encode()) for x in w) >= 300:
                    yield at, tuple(w)
    first, out = {}, {}
    for (i, t), all_lines in sorted(filled.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        gone = {at + k for at, w in windows(all_lines) if first.setdefault(w, (i, t, at)) != (i, t, at) for k in range(len(w))}
        out[i, t] = (t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(all_lines), len(gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 4])
def test_long_passages_of_few_lines_go(documents, clashing, run):
    draw = random.Random(run)
    pool = [long_line(1), long_line(2, 50), long_line(3, 20), long_line(4, 26), "short one", "short two", "日本語の文章" * 20]
    docs = [(i, "\n".join(draw.choice([*pool, f"own {i} {k}"]) for k in range(draw.randint(1, 8)))) for i in range(60)]
    docs += [(100, long_line(9)), (101, long_line(9)), (None, long_line(9)), (102, "x"), (103, "x"), (104, None)]
    wanted = brute_large(docs, run)
    rows = lines.dedup_lines(clashing(documents(docs)), run=run).select("row.doc_id", "row.text", "lines.*").toDF("i", "was", "text", "n", "gone").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.text, r.n, r.gone) == wanted[r.i, r.was] if r.was is not None else r.text is None, r.i


def test_one_long_line_between_others(documents):
    docs = [(i, f"before {i}\n{long_line(5)}\nafter {i}") for i in range(3)] + [(10, long_line(6)), (11, long_line(6) + " ")]
    found = {r.doc_id: r.text for r in lines.dedup_lines(documents(docs)).select("row.doc_id", "lines.text").collect()}
    assert found == {0: docs[0][1], 1: "before 1\nafter 1", 2: "before 2\nafter 2", 10: docs[3][1], 11: ""}
