import random
import re

import pytest

from folioscope.llm import fertility

PROSE = "The committee met on Tuesday to discuss the new library building and its cost to the town. Members asked about parking."


def plain(text):
    """The base measures, written out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


TEXTS = [
    PROSE,
    PROSE + "\n" + PROSE + "\n\n" + PROSE,
    None,
    "",
    " \n\t ",
    "a b c d e a b c d e f a b c d e",
    "x y z # * $ % & | < > <<é>>\x0bq\x0cr\x1cs",
    "\n".join(["one line", "one line ", "one line", "", ""]),
    "word " * 3000,
    "日本語のテキストです。これは単語の境界がない文章であり、十分に長い。 " * 3,
    "9 " * 9,
]


def test_base_measures(documents, clashing):
    draw = random.Random(1)
    texts = TEXTS + [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 60))) for _ in range(40)]
    rows = fertility.judge(clashing(documents(list(enumerate(texts))))).select("row.doc_id", "fertility.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_verdicts(documents):
    junk = " ".join("%x" % random.Random(i).getrandbits(90) for i in range(60))
    bytes_only = " ".join(chr(0x12000 + i) * 4 for i in range(40))
    few = " ".join(["buy now cheap"] + ["pills %d" % (i % 3) for i in range(0)] + ["x"] * 40)
    rows = [(1, PROSE), (2, junk), (3, bytes_only + " " + "ab " * 30), (4, few), (5, None), (1, PROSE), (None, PROSE)]
    kept = [(r.doc_id, r.kept) for r in fertility.judge(documents(rows)).select("row.doc_id", "fertility.kept").collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, True), (1, True), (None, True), (2, False), (3, False), (4, False), (5, False)], key=str
    )


@pytest.mark.parametrize(
    "text, script", [("abc é", "latin"), ("привет мир abc", "cyrillic"), ("γειά", "greek"), ("漢字かな a", "cjk"), ("12 !", ""), ("", "")]
)
def test_script(text, script):
    assert fertility.script_of(text) == script


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    judged = fertility.judge(docs).select("row.doc_id", "fertility.*").join(clean, "doc_id")
    assert judged.filter("not base_failed and not kept").count() == 0


def test_no_documents(documents):
    assert fertility.judge(documents([])).collect() == []
