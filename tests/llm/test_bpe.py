import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import bpe
from folioscope.llm.queries import QUERIES
from tests.compare import TESTDATA

FILE = public_tokenizers.path(bpe.VOCABULARY)
HARD = [
    None,
    "",
    " \t\n",
    "It's THEY'LL we'd 'S 12 3.5 _x_ a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>",
    "ΣΑΣ Σ İstanbul ıǅ é é ﬁ ① ² ½ ٣ क्षि ไทย 中文日本 \u0085x y　z \x00\x1c\x1f",
    "👍🏽‍👩 " * 3,
    "aaaa aaaaa " + "a" * 5000 + "ab" * 3000 + " " + "é" * 1000,
    "= " * 3000 + "=" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def merged(symbols, ranks):
    """Merges applied one rule after the other."""
    symbols = list(symbols)
    for (u, v), w in ranks:
        i, out = 0, []
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == (u, v):
                out.append(w)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.lists(st.integers(0, 2), max_size=10))
def test_automaton_of_any_merges_accepts_exactly_what_merging_gives(pairs, text):
    spelled, ranks = [(0,), (1,), (2,)], []
    for u, v in pairs:
        u, v = u % len(spelled), v % len(spelled)
        if spelled[u] + spelled[v] not in spelled:
            spelled.append(spelled[u] + spelled[v])
            ranks.append(((u, v), len(spelled) - 1))
    machine = bpe.Automaton(len(spelled), [(u, v, w) for (u, v), w in ranks])
    paths = [[]]
    for sequence in paths:
        at = sum(len(spelled[t]) for t in sequence)
        for t, s in enumerate(spelled):
            if tuple(text[at : at + len(s)]) == s and machine.accepts([*sequence, t]):
                paths.append([*sequence, t])
    whole = [p for p in paths if sum(len(spelled[t]) for t in p) == len(text)]
    assert whole == [merged(text, ranks)]
    states, tokens = zip(*[(q, t) for q in range(len(machine.removed)) for t in range(len(spelled))])
    import numpy as np

    many = machine.have_arcs(np.array(states), np.array(tokens)).tolist()
    assert many == [machine.has_arc(q, t) for q, t in zip(states, tokens)]


def test_ids_and_text_are_those_of_the_library(spark, documents, library, clashing):
    random.seed(3)
    letters = "aabceinth's é́ß٣Σ<|endoftext|>中ไ\x00-!? "
    texts = HARD + ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    found = sorted(map(repr, bpe.encode(clashing(documents(rows))).collect()))
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert found == sorted(f"Row(doc_id={i!r}, ids={ids!r}, decoded={d!r})" for i, ids, d in expected)


def test_long_and_short_pieces_take_the_same_path(library):
    codec = bpe.Codec(FILE)
    random.seed(5)
    pieces = ["".join(random.choices("aeinrst", k=random.randrange(1, 200))).encode() for _ in range(300)]
    assert codec.pieces(pieces) == [codec.piece(p) for p in pieces]
    assert codec.pieces(pieces) == [library.encode(p.decode(), add_special_tokens=False).ids for p in pieces]


def test_decoding_takes_any_ids(spark, library):
    ids = library.encode("the cat's", add_special_tokens=False).ids
    vocab = json.load(open(FILE))["model"]["vocab"]
    split = [vocab["t"], vocab["h"], vocab["e</w>"]]
    df = spark.createDataFrame([(1, ids), (2, split), (3, None), (4, [10**6, *ids]), (5, [])], "doc_id bigint, ids array<int>")
    found = {r.doc_id: (r.decoded, r.canonical) for r in bpe.decode(df).collect()}
    text = library.decode(ids, skip_special_tokens=False)
    assert found == {1: (text, True), 2: ("t h e</w>", False), 3: ("", True), 4: (text, False), 5: ("", True)}


def test_empty_table(documents):
    empty = documents([]).filter("false")
    assert bpe.encode(empty).collect() == []


def test_query_over_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        expected.append((i, len(ids), *digests))
    found = QUERIES["op13_tokenization_automaton"](spark, TESTDATA).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
