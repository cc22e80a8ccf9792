import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, vocabulary
from folioscope.llm.vocabulary import word_bpe

ODD = [
    "Don't stop, it's 'sword ('s we'll 12a3 x2, 日本語、テスト!  a b <|endoftext|>x a<|endoftext|> !!! a_b-c.",
    "İstanbul ẞ ﬁ é É. H̱ ÀÉÿß, ＡＢＣ ½ ²,",
    "I'M HERE'S dogs' 's 't. \x1c! !\x1c! naïve'll. (quoted) \"x\".",
    "Ǆ ǰ ŉ Å µ ª º Ω Σς ΑΣ. 🙂🙂, x🙂. 'LL 'Ll, A'RE.  nbsp em.",
    "",
    " \t\n",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_ids_of_words_are_the_ids_of_the_text(tokenizer):
    words = word_bpe(packing.VOCABULARY)
    for text in ODD:
        ids = np.frombuffer(words.of(text.encode().split()), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_level_is_the_one_with_the_least_sum_of_squares():
    draw = random.Random(3)
    capacity, levels, counts = 12, packing.Levels(12), [0] * 13
    for window in range(400):
        size = draw.randint(1, 11)

        def after(level):
            n = counts[:]
            if level:
                n[level] -= 1
            if level + size < capacity:
                n[level + size] += 1
            return sum(x * x for x in n[1:capacity])

        fits = [0] + [h for h in range(1, capacity - size + 1) if counts[h]]
        chosen = levels.choose(size)
        assert chosen in fits and after(chosen) == min(map(after, fits))
        if chosen:
            levels.take(chosen)
            counts[chosen] -= 1
        levels.put(window, chosen + size)
        if chosen + size < capacity:
            counts[chosen + size] += 1


@pytest.mark.parametrize("max_open", [packing.MAX_OPEN, 2])
def test_pieces_make_up_the_documents(documents, clashing, tokenizer, max_open):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["alpha", "be,", "Gamma-ray", "ñandú."]) for _ in range(draw.randint(0, 90)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, None), (None, "no id"), (7, "again " * 500), (7, "again " * 500)]
    pieces = packing.pack(clashing(documents(rows)), capacity=64, max_open=max_open).collect()

    wanted = defaultdict(list)
    for i, text in rows:
        wanted[i].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID])
    sequences, covered = defaultdict(list), defaultdict(int)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        of_doc = next(ids for ids in wanted[p.doc_id] if len(ids) == p.doc_tokens)
        part = np.array(of_doc[p.start : p.start + p.length], "<u4").tobytes()
        assert len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
        covered[p.doc_id] += p.length
    assert covered == {i: sum(map(len, ids)) for i, ids in wanted.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 64 and at & (at - 1) == 0 or at == 64


def test_no_documents(documents):
    assert packing.pack(documents([])).collect() == []


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [r["n"] for r in packing.pack(docs).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n < 2048 for n in sizes) <= 12 * docs.rdd.getNumPartitions()


def test_words_of_many_texts_are_told_apart_once(monkeypatch):
    """Texts are encoded in groups: a repeated word is looked up once, and the ids are those of each text alone."""
    words = word_bpe(packing.VOCABULARY)
    texts = [t if isinstance(t, bytes) else t.encode() for t in ODD]
    texts += [b"", None, b"  a  b ", b"\xff\xfe a\xe9 b", b"x\x0by\x0cz\x1cq", b"same " * 50, b"\n", b"same again"]
    wanted = [words.of((t or b"").split()) for t in texts]
    column = pa.array(texts, pa.binary())
    for size in (1, 60, vocabulary.TEXT_BYTES):
        monkeypatch.setattr(vocabulary, "TEXT_BYTES", size)
        assert [*words.of_texts(column)] == wanted
        assert [*words.of_texts(column[3:9])] == wanted[3:9]
    asked = []
    each = words.each
    monkeypatch.setattr(words, "each", lambda some: asked.extend(some) or each(some))
    assert [*words.of_texts(column)] == wanted
    assert len(asked) == len(set(asked))
    assert [*words.of_texts(column[:0])] == []
