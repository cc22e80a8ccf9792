"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Words are runs of letters in lower case; their n-grams of 1 to ``MAX_N`` characters, word ends
included, are hashed into ``BUCKETS`` features. A text's feature is the share of its n-grams in the
bucket times the bucket's inverse document frequency. Document frequencies come from all learning
rows, counted in the tasks and summed. The weights are trained on at most ``SAMPLE`` of them, taken
evenly over the languages by a hash of the id, with follow-the-regularised-leader under an L1 and an
L2 penalty; a part of the sample that isn't trained on sets the temperature that divides the logits.

Since shares add up over words, a text's logits are the sum of its words' own, which each worker keeps
for the words it has met. The model is one matrix of (buckets + 1) x languages, whatever the size of the
corpus.

Null texts and texts without a letter are ``und`` with score 0, as is everything when there is nothing
to learn from. Rows without a language aren't learned from. Rows are judged alone: repeated rows get
equal answers, an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_N = 3
BUCKETS = 1 << 15
#: Learning rows that the weights are fitted on, over all languages.
SAMPLE = 6000
#: One in so many rows of the sample sets the temperature.
CALIBRATION = 5
EPOCHS = 3
UNKNOWN = "und"
#: Brings shares of n-grams, which are small, to the order of 1.
_SCALE = 30.0
_LETTERS = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 300_000


@dataclass(frozen=True)
class Penalties:
    """Step size and elastic net of the learner."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01


class _Buckets(dict):
    """The bucket of an n-gram, kept once it was asked for: there are few n-grams of so few letters."""

    def __missing__(self, gram: str) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        bucket = self[gram] = zlib.crc32(gram.encode()) % BUCKETS
        return bucket


_BUCKET = _Buckets()


def word_features(word: str) -> list[int]:
    """Buckets of the n-grams of a word with its ends marked."""
    marked = f"\x02{word}\x03"
    found = [_BUCKET[c] for c in word]
    for n in range(2, MAX_N + 1):
        found += [_BUCKET[marked[i : i + n]] for i in range(len(marked) - n + 1)]
    return found


class Recent:
    """What was made of the words met lately, by a function that makes it for a list of new words.

    Words of the last ``_KEPT_WORDS`` new ones stay; older ones stay if they were met again meanwhile.
    """

    def __init__(self, make):
        self._make = make
        self._kept: dict = {}
        self._older: dict = {}

    def of(self, words: list[str]) -> list:
        kept = self._kept
        try:
            return [kept[w] for w in words]
        except KeyError:
            pass
        missing = set(words).difference(kept)
        if len(kept) > _KEPT_WORDS:
            # The words of this text are looked up anew, most of them among the older ones.
            self._older, self._kept, missing = kept, {}, set(words)
            kept = self._kept
        new = []
        for w in missing:
            if w in self._older:
                kept[w] = self._older[w]
            else:
                new.append(w)
        kept.update(zip(new, self._make(new)) if new else ())
        return [kept[w] for w in words]


def _feature_bytes(words: list[str]) -> list[bytes]:
    import numpy as np

    return [np.array(word_features(w), "<i4").tobytes() for w in words]


class Features:
    """The buckets of words, joined."""

    def __init__(self):
        self._recent = Recent(_feature_bytes)

    def of(self, words: list[str]):
        import numpy as np

        return np.frombuffer(b"".join(self._recent.of(words)), "<i4")


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """``bucket, n``: in how many texts each bucket occurs; bucket -1 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        features, counts, n = Features(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                words = list(set(_LETTERS.findall((x.as_py() or "").lower())))
                counts += np.bincount(features.of(words), minlength=BUCKETS) > 0
                n += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(seen, -1), "n": np.append(counts[seen], n)})

    return df.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


class Learner:
    """Follow-the-regularised-leader with per-coordinate steps, one weight column for each class."""

    def __init__(self, size: int, classes: int, penalties: Penalties):
        import numpy as np

        self.np = np
        self.p = penalties
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))

    def weights(self, at=slice(None)):
        z, p = self.z[at], self.p
        shrunk = self.np.sign(z) * p.l1 - z
        return self.np.where(abs(z) <= p.l1, 0.0, shrunk / ((p.beta + self.np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, at, x, label: int) -> None:
        np = self.np
        w = self.weights(at)
        e = np.exp((logits := x @ w) - logits.max())
        e /= e.sum()
        e[label] -= 1.0
        g = x[:, None] * e[None, :]
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def temperature(logits, labels) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid."""
    import numpy as np

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean())

    return min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss) if len(labels) else 1.0


@dataclass(frozen=True)
class Model:
    """Languages, the logits that a bucket adds per occurrence (times the number of n-grams), bias, temperature."""

    languages: tuple[str, ...]
    weights: bytes
    bias: tuple[float, ...]
    temperature: float

    def matrix(self):
        import numpy as np

        return np.frombuffer(self.weights, "<f8").reshape(BUCKETS, len(self.languages))


def fit(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    epochs: int = EPOCHS,
    penalties: Penalties = Penalties(),
) -> Model | None:
    """The model of ``df``'s rows with a language; None if there are none."""
    rows = df.filter(F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)).alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes, key=lambda x: (-sizes[x], x))[: sample // 2])
    if not languages:
        return None
    found = {r["bucket"]: r["n"] for r in document_frequencies(rows, "text").collect()}
    total = found.pop(-1, 0)
    share = max(1, sample // len(languages))
    limits = [F.lit(x) for k in languages for x in (k, min(1 << 30, (share << 30) // sizes[k]))]
    drawn = rows.filter(F.col("draw") < F.create_map(*limits)[F.col("lang")]).limit(2 * sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        idf = np.full(BUCKETS, np.log(1 + total) + 1)
        idf[list(found)] = np.log((1 + total) / (1 + np.array(list(found.values()), float))) + 1
        features, examples = Features(), []
        for batch in batches:
            for x, k, draw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams = features.of(_LETTERS.findall((x or "").lower()))
                if len(grams):
                    at, counts = np.unique(grams, return_counts=True)
                    values = counts * idf[at] * (_SCALE / len(grams))
                    examples.append((draw, languages.index(k), np.append(at, BUCKETS), np.append(values, 1.0)))
        examples.sort(key=lambda e: e[:2])
        learner = Learner(BUCKETS + 1, len(languages), penalties)
        held = [e for e in examples if e[0] % CALIBRATION == 0]
        for _ in range(epochs):
            for draw, label, at, x in examples:
                if draw % CALIBRATION:
                    learner.learn(at, x, label)
        w = learner.weights()
        t = temperature(np.array([x @ w[at] for _, _, at, x in held]), np.array([e[1] for e in held], int))
        folded = w[:BUCKETS] * idf[:, None] * _SCALE
        yield pa.RecordBatch.from_pydict(
            {"weights": [folded.astype("<f8").tobytes()], "bias": [w[BUCKETS].tolist()], "temperature": [t]}
        )

    fitted = drawn.coalesce(1).mapInArrow(train, "weights binary, bias array<double>, temperature double").collect()[0]
    return Model(languages, bytes(fitted["weights"]), tuple(fitted["bias"]), fitted["temperature"])


class WordLogits:
    """What each word adds to the logits of a text, and its number of n-grams in the last column."""

    def __init__(self, model: Model):
        import numpy as np

        self.np = np
        self.matrix = model.matrix()
        self.bias = np.array(model.bias)
        self._recent = Recent(self._make)

    def _make(self, words: list[str]) -> list[bytes]:
        np = self.np
        grams = [word_features(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        flat = np.array([x for g in grams for x in g])
        sums = np.add.reduceat(self.matrix[flat], np.cumsum(sizes) - sizes, axis=0)
        rows = np.ascontiguousarray(np.column_stack([sums, sizes]))
        width = rows.itemsize * rows.shape[1]
        data = rows.tobytes()
        return [data[i : i + width] for i in range(0, len(data), width)]

    def of(self, words: list[str]):
        """The logits of a text of these words, before the temperature."""
        found = b"".join(self._recent.of(words))
        total = self.np.frombuffer(found).reshape(len(words), -1).sum(axis=0)
        return total[:-1] / total[-1] + self.bias


_LOADED: dict[tuple, WordLogits] = {}


def _loaded(model: Model) -> WordLogits:
    """The word table of this worker; another model replaces it."""
    mark = (model.languages, model.bias, zlib.crc32(model.weights))
    if mark not in _LOADED:
        _LOADED.clear()
        _LOADED[mark] = WordLogits(model)
    return _LOADED[mark]


def predictions(text: Column, model: Model | None) -> Column:
    """``lang_pred`` and ``score`` of a text column, as a struct."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(texts: pa.Array) -> pa.Array:
        import numpy as np

        table = _loaded(model)
        best, scores = [], []
        for raw in texts:
            words = _LETTERS.findall((raw.as_py() or "").lower())
            if not any(c.isalpha() for w in words for c in w):
                best.append(UNKNOWN)
                scores.append(0.0)
                continue
            logits = table.of(words)
            e = np.exp((logits - logits.max()) / model.temperature)
            k = int(e.argmax())
            best.append(model.languages[k])
            scores.append(float(e[k] / e.sum()))
        columns = [pa.array(best, pa.string()), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(text)
