"""Quality rules by tokeniser fertility.

A public vocabulary is trained on ordinary text, so text that it cuts into many small tokens, spells
byte by byte, or covers with few different tokens is rarely prose. Measured per document, over whole
texts: characters per token, share of byte-fallback tokens, and the entropy of the document's tokens
as a share of the most that so many tokens, or ``ENTROPY_TOKENS`` if there are more, can have. The bands stand per script, the one that most
letters of the text belong to, since a vocabulary serves scripts unequally.

Before the bands come the base rules: at least ``MIN_WORDS`` words, and at most ``MAX_REPEAT`` percent
of the words in 5-word windows that occur twice or more in the text.

A null or empty text has no words and isn't kept. Each row is judged alone, so repeated rows get equal
verdicts, an empty table gives none, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import whole

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
#: A language has so many common tokens that longer texts hardly show more; entropy is a share of this many at most.
ENTROPY_TOKENS = 4096


@dataclass(frozen=True)
class Band:
    """What a kept document of a script must show."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: Bands of the production query for ``VOCABULARY``; "" holds for every other script.
BANDS = {
    "latin": Band(1.25, 6.5, 0.08, 0.45),
    "cyrillic": Band(1.0, 6.0, 0.10, 0.40),
    "greek": Band(0.7, 3.0, 0.20, 0.35),
    "arabic": Band(0.6, 3.0, 0.30, 0.35),
    "cjk": Band(0.35, 2.0, 0.85, 0.30),
    "": Band(0.25, 6.5, 1.0, 0.25),
}

#: First and last code point of the blocks whose letters name a script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
}

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, byte_share double, entropy double, script string"
)
_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_FIELDS = [(name, _TYPES[kind]) for name, kind in (x.split() for x in MEASURES.split(", "))]

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that occur twice or more, the first included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = (windows ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    at = np.flatnonzero(repeated)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + width, -1)
    return int((np.cumsum(starts) > 0).sum())


def script_of(text: str) -> str:
    """The script with the most letters, "" if none of ``SCRIPTS`` has any."""
    import numpy as np

    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = {s: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in ranges) for s, ranges in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else ""


def measure(raw: bytes | None, pieces, is_byte) -> tuple:
    """The values of ``MEASURES`` for one text."""
    import numpy as np

    raw = raw or b""
    words = raw.split()
    chars = len(raw.translate(None, _SPACE + _CONTINUATION))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    tokens = np.frombuffer(pieces.of(words), "<u4")
    n = len(tokens)
    byte_share = entropy = 0.0
    if n:
        counts = np.bincount(tokens)
        byte_share = float(counts[is_byte[: len(counts)]].sum()) / n
        p = counts[counts > 0] / n
        most = np.log2(min(n, ENTROPY_TOKENS))
        entropy = float(-(p * np.log2(p)).sum() / most) if most else 0.0
    return (
        len(words),
        chars,
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        n,
        chars / n if n else 0.0,
        byte_share,
        entropy,
        script_of(raw.decode("utf-8", "replace")),
    )


def measures(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The struct of ``MEASURES`` for a text column."""

    def run(texts: pa.Array) -> pa.Array:
        import numpy as np

        from folioscope.llm.vocabulary import word_pieces

        pieces, model = word_pieces(vocabulary)
        is_byte = np.array([model.IsByte(i) for i in range(model.GetPieceSize())])
        rows = [measure(x.as_py(), pieces, is_byte) for x in texts]
        columns = zip(*rows) if rows else [[] for _ in _FIELDS]
        return pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)], names=[name for name, _ in _FIELDS]
        )

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<{MEASURES}>")(text.cast("binary"))


def base_failed(m: Column) -> Column:
    """Fewer than ``MIN_WORDS`` words, or too many of them in repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])


def in_band(m: Column, bands: dict[str, Band]) -> Column:
    """Whether all three measures lie within the band of the text's script."""

    def inside(b: Band) -> Column:
        return (
            m["chars_per_token"].between(b.min_chars_per_token, b.max_chars_per_token)
            & (m["byte_share"] <= b.max_byte_share)
            & (m["entropy"] >= b.min_entropy)
        )

    verdict = inside(bands[""])
    for script, band in bands.items():
        if script:
            verdict = F.when(m["script"] == script, inside(band)).otherwise(verdict)
    return verdict


def judge(
    df: DataFrame, text: str = "text", bands: dict[str, Band] = BANDS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``row`` (the row of ``df``) and ``fertility``: the measures, ``base_failed`` and ``kept``."""
    m = F.col("fertility")
    return (
        df.select(whole(df).alias("row"), measures(F.col(text), vocabulary).alias("fertility"))
        .withColumn("fertility", m.withField("base_failed", base_failed(m)))
        .withColumn("fertility", m.withField("kept", ~m["base_failed"] & in_band(m, bands)))
    )
