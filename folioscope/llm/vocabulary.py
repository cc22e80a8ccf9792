"""Public vocabularies inside tasks: token ids per word, kept per worker.

A vocabulary is named by its file; ``public_tokenizers.path`` finds it on each executor. Words are
what lies between the white space of ASCII. Neither tokeniser lets a token cross it, so the ids of a
text are the ids of its words one after the other, and each distinct word is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker are at most twice as many; longer words are encoded each time.
KEPT_WORDS = 150_000
LONGEST_KEPT = 64
#: Texts whose words are told apart together, in bytes; a longer text is alone.
TEXT_BYTES = 8_000_000

#: The vocabulary that this worker used last. Workers outlive stages, so it gives way to the next one.
_LOADED: dict[str, tuple] = {}


def _loaded(name: str, make: Callable[[str], tuple]) -> tuple:
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = make(public_tokenizers.path(name))
    return _LOADED[name]


class WordIds:
    """Little-endian 32-bit ids of words, by a function that encodes a list of words.

    Words of the last ``KEPT_WORDS`` new ones stay; older ones stay if they were met again meanwhile.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        self._encode = encode
        self._kept: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> bytes:
        """The ids of the words, joined."""
        return b"".join(self.each(words))

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        ids = list(map(self._kept.get, words))
        if None not in ids:
            return ids
        found = {w: self._older.get(w) for w, i in zip(words, ids) if i is None}
        new = [w for w, i in found.items() if i is None]
        found.update(zip(new, self._encode(new)))
        ids = [found[w] if i is None else i for w, i in zip(words, ids)]
        if len(self._kept) > KEPT_WORDS:
            self._older, self._kept = self._kept, {}
        if max(map(len, found)) > LONGEST_KEPT:
            found = {w: i for w, i in found.items() if len(w) <= LONGEST_KEPT}
        self._kept.update(found)
        return ids

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, joined; a null has none. Words are told apart once per ``TEXT_BYTES`` of texts."""
        start = 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        while start < len(texts):
            end, size = start + 1, sizes[start]
            while end < len(texts) and size + sizes[end] <= TEXT_BYTES:
                size += sizes[end]
                end += 1
            yield from self._of_some(texts[start:end])
            start = end

    def _of_some(self, texts: pa.Array) -> list[bytes]:
        # Bytes that aren't UTF-8 stay as they are: only white space of ASCII is looked for.
        plain = pc.fill_null(texts.cast(pa.large_binary()), b"").cast(pa.large_string(), safe=False)
        words = pc.ascii_split_whitespace(plain)
        # The bounds of a slice count from the first word of the whole.
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        distinct = words.flatten().dictionary_encode()
        spellings = distinct.dictionary.cast(pa.large_binary()).to_pylist()
        ids = pa.array(self.each(spellings), pa.large_binary()).take(distinct.indices)
        of_text = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), ids)
        return pc.binary_join(of_text, pa.scalar(b"", pa.large_binary())).to_pylist()


def _ids(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


#: Punctuation of ASCII; at the end of a word the tokeniser always cuts it off in one piece.
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that lower case and normal form leave one letter each.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A word that such a letter or a digit ends, but for punctuation. A special token's text isn't one.
_ENDED = re.compile(rb"(?!.*<\|).*(?:[A-Za-z0-9]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])", re.S)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free one from 256."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}


class _WordBpe:
    """Ids of single words for a file of the tokenizers library, without special tokens.

    Most words are letters and then punctuation. Their letters go straight to the vocabulary's merges,
    once for each spelling in lower case; every other word goes through the whole tokeniser.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        self._model = self._tokenizer.model
        self._letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        #: The bytes of each id.
        self._bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._parts: dict[bytes, bytes] = {}

    def _part(self, part: bytes) -> bytes:
        """Ids of a run of letters or of punctuation."""
        if part.isalpha():
            # Letters of ASCII, which byte-level vocabularies write as they are.
            key = part.lower()
            ids = self._parts.get(key)
            if ids is None:
                ids = self._parts[key] = self._merged(key.decode("ascii"))
            return ids
        ids = self._parts.get(part)
        if ids is None:
            text = part.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                key = text.lower().encode()
                ids = self._parts.get(key)
                if ids is None:
                    ids = self._parts[key] = self._merged(key.decode("latin-1").translate(self._letters))
            else:
                ids = self._parts[part] = _ids(self._tokenizer.encode(text, add_special_tokens=False).ids)
        return ids

    def _merged(self, spelled: str) -> bytes:
        of = self._bytes
        return b"".join([of[t.id] for t in self._model.tokenize(spelled)])

    def __call__(self, words: list[bytes]) -> list[bytes]:
        if len(self._parts) > KEPT_WORDS:
            self._parts.clear()
        out = []
        for w in words:
            letters = w.rstrip(_PUNCTUATION)
            if len(letters) < len(w) and (letters.isalpha() or _ENDED.fullmatch(letters)):
                out.append(self._part(letters) + self._part(w[len(letters) :]))
            else:
                out.append(self._part(w))
        return out


def word_bpe(name: str) -> WordIds:
    """Ids of a file for the tokenizers library, without special tokens."""
    return _loaded(name, lambda file: (WordIds(_WordBpe(file)),))[0]


def word_pieces(name: str) -> tuple[WordIds, object]:
    """Ids of a sentencepiece model, and the model."""

    def make(file: str) -> tuple:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)

        def encode(words: list[bytes]) -> list[bytes]:
            found = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            return [_ids(ids) for ids in found]

        return WordIds(encode), model

    return _loaded(name, make)
