import random
import re

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import components, simhash


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    """node -> least node that it reaches."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@given(st.sets(st.integers(0, 63), max_size=simhash.RADIUS), st.integers(0, 2**64 - 1))
def test_some_mask_has_none_of_the_bits_that_differ(bits, shared):
    shared &= ~sum(1 << b for b in bits)
    assert any(not m >> b & 1 for m in simhash.masks() for b in [0])
    assert any(all(not m >> b & 1 for b in bits) for m in simhash.masks())
    assert any(all(not m >> b & 1 for b in bits) and m & shared == shared for m in simhash.masks(shared))


def test_masks_take_half_of_the_bits():
    assert len(simhash.masks()) == 31 and all(30 <= m.bit_count() <= 34 for m in simhash.masks())


@pytest.mark.parametrize("text", ["", None, "one", "One two THREE", "a b c d e f g É é\x0bz\x1cq", "word " * 500, "x y " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == fingerprint(text)


@pytest.mark.parametrize("largest_group", [simhash.LARGEST_GROUP, 3])
def test_links_of_fingerprints(spark, largest_group):
    draw = random.Random(6)
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = set(centres)
    for c in centres[:5]:
        for _ in range(25):
            x = c
            for bit in draw.sample(range(64), draw.randint(1, 7)):
                x ^= 1 << bit
            prints.add(x)
    prints |= {1 << i for i in range(8)} | {0}
    signed = {simhash._signed(p): p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "print bigint")
    links = simhash.near_links(frame, largest_group=largest_group)
    found = components.components(links, "a", "b").collect()
    roots = {s: s for s in signed} | {r.node: r.root for r in found}
    assert roots == classes(list(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 4)


def test_components_of_paths_stars_and_rings(spark):
    draw = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (-7, 3000), (3000, -7)]
    draw.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    expected = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    expected |= {2000 + i: 2000 for i in range(1, 50)} | {3000: -7}
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_documents(documents, clashing):
    base = " ".join(f"word{i}" for i in range(300))
    docs = [(9, base), (4, base.upper()), (7, base + " more"), (2, "something else entirely different from the rest"), (3, None)]
    docs += [(8, ""), (None, base), (2, docs[3][1]), (5, " \n"), (None, "lonely text of no id at all"), (11, "long " * 50_000)]
    rows = simhash.near_duplicates(clashing(documents(docs))).collect()
    prints = {fingerprint(t) for _, t in docs}
    label = classes(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    wanted = []
    for i, t in docs:
        same = [j for j, u in docs if j is not None and label[fingerprint(u)] == label[fingerprint(t)]]
        wanted.append((i, f"{fingerprint(t):016x}", min(same) if same else None))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == sorted(wanted, key=str)
    assert simhash.near_duplicates(documents([])).collect() == []


def test_groups_are_made_where_their_rows_meet(documents):
    """No task holds all its fingerprints once per mask: rows are sent before they are combined."""
    prints = documents([(i, "") for i in range(50)]).selectExpr("doc_id * 977 as print")
    plan = simhash.near_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(mask")
