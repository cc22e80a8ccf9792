"""Encoding and decoding by a tokenization automaton.

The merges of a byte-pair vocabulary become a deterministic automaton over tokens that accepts exactly
the sequences which encoding can give. It starts with one state that every single symbol leads back to,
and takes one merge gadget per merge ``u v -> w`` in rank order: the arcs of ``u`` get a target of their
own, a copy without the arc of ``v``, and wherever an arc of ``u`` begins, an arc of ``w`` goes to what
``u v`` led to (a merge whose ``u v`` is no path makes no arcs). So the state after a token depends on
that token alone, and the table is held by what it lacks: for each state, the tokens whose arc was removed
and the merge that did it. An arc ``w`` exists if none of the tokens that ``w`` grew from on its left had
lost its arc when ``w`` was made.

A pre-split word has exactly one accepted path, and so has each of its prefixes; encoding follows arcs,
with no merging. A token with the end of a word leads to the first state, so the ids of a whole text are
one path. Decoding follows the ids and emits the label of each arc.

Texts are normalised and pre-split as the vocabulary's file says; of its words, those met lately are kept
per worker, and the new ones of many texts are encoded together. Single rows need no shuffle.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.vocabulary import LONGEST_KEPT, _byte_letters, _loaded

VOCABULARY = "word_bpe_49k.json"
#: Pieces up to this length are encoded many at a time, longer ones alone.
LONGEST_TOGETHER = 64
MOST_TOGETHER = 8192
#: Bytes of text whose new words are looked for together.
TOGETHER_BYTES = 2 << 20
#: Words that a worker keeps; of the words met before, as many more.
KEPT_WORDS = 150_000

_END = "</w>"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string()), ("canonical", pa.bool_())])


class Automaton:
    """The automaton of a list of merges ``(u, v, w)`` of token numbers below ``tokens``, in rank order."""

    def __init__(self, tokens: int, merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        #: The state that the arcs of a token lead to.
        self.target = [0] * tokens
        #: Per state, the tokens whose arc was removed, and by which merge.
        self.removed: list[dict[int, int]] = [{}]
        #: Per token, the tokens it grew from on its left, each with the merge that made the next one.
        self.grown: list[tuple[tuple[int, int], ...]] = [()] * tokens
        #: Tokens that no path has, as what would merge to them never meets.
        self.idle: set[int] = set()
        sharing = [tokens]
        for rank, (u, v, w) in enumerate(merges):
            before = after = self.target[u]
            if u in self.idle or not self.has_arc(before, v):
                self.idle.add(w)
                continue
            if sharing[before] > 1 or u == v:
                after = len(self.removed)
                self.removed.append(dict(self.removed[before]))
                sharing[before] -= 1
                sharing.append(1)
                self.target[u] = after
            self.removed[after][v] = rank
            sharing[self.target[w]] -= 1
            self.target[w] = before if u == v else self.target[v]
            sharing[self.target[w]] += 1
            self.grown[w] = (*self.grown[u], (u, rank))
        size = [len(row) for row in self.removed]
        lacks = np.repeat(np.arange(len(size)) * tokens, size) + np.fromiter((t for row in self.removed for t in row), np.int64)
        order = np.argsort(lacks)
        self._lacks = lacks[order]
        self._lost = np.fromiter((rank for row in self.removed for rank in row.values()), np.int64)[order]
        self._idle = np.isin(np.arange(tokens), list(self.idle))
        self._targets = np.array(self.target, np.int64)
        self._left = np.full(tokens, -1, np.int64)
        self._made = np.full(tokens, -1, np.int64)
        for rank, (u, _, w) in enumerate(merges):
            self._left[w], self._made[w] = u, rank

    def has_arc(self, state: int, token: int) -> bool:
        removed = self.removed[state]
        return token not in removed and token not in self.idle and all(removed.get(t, rank + 1) > rank for t, rank in self.grown[token])

    def have_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``has_arc`` of many pairs."""
        have = ~self._idle[tokens]
        if not len(self._lacks):
            return have
        rows, limit = np.arange(len(states)), np.full(len(states), len(self._left), np.int64)
        while len(rows):
            key = states * self.tokens + tokens
            at = np.minimum(np.searchsorted(self._lacks, key), len(self._lacks) - 1)
            gone = (self._lacks[at] == key) & (self._lost[at] <= limit)
            have[rows[gone]] = False
            limit, tokens_left = self._made[tokens], self._left[tokens]
            go = ~gone & (tokens_left >= 0)
            rows, states, tokens, limit = rows[go], states[go], tokens_left[go], limit[go]
        return have

    def go(self, tokens: np.ndarray) -> np.ndarray:
        """The states after the tokens."""
        return self._targets[tokens]

    def accepts(self, ids: list[int]) -> bool:
        """Whether the ids are a path, that is, whether the merges leave them as they are."""
        state = 0
        for t in ids:
            if not 0 <= t < self.tokens or not self.has_arc(state, t):
                return False
            state = self.target[t]
        return True


class Codec:
    """Ids and labels of words for a file of the tokenizers library whose model is a byte-level BPE with word ends."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or content["decoder"] is not None:
            raise ValueError(f"{file}: not a byte-level BPE with word ends and plain decoding")
        special = content["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{file}: special tokens that aren't plain text")
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(
            max(max(vocab.values()), *[t["id"] for t in special]) + 1,
            [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges],
        )
        self.labels = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in special}
        self._special = {t["content"]: t["id"] for t in special}
        self._special_text = re.compile("(" + "|".join(re.escape(t) for t in self._special) + ")") if special else None
        self._tokenizer = Tokenizer.from_file(file)
        self._byte = {c: b for b, c in _byte_letters().items()}
        self._index(vocab)
        self._kept: dict[str | int, tuple[bytes, str]] = {}
        self._older: dict[str | int, tuple[bytes, str]] = {}

    def _index(self, vocab: dict[str, int]) -> None:
        """Per byte string that begins a token: the token within a word and the one at its end, or -1."""
        self._tokens: dict[bytes, tuple[int, int]] = {}
        for label, i in vocab.items():
            ends = label.endswith(_END) and len(label) > len(_END)
            spelled = bytes(self._byte[c] for c in (label[: -len(_END)] if ends else label))
            for n in range(1, len(spelled)):
                self._tokens.setdefault(spelled[:n], (-1, -1))
            inner, last = self._tokens.get(spelled, (-1, -1))
            self._tokens[spelled] = (inner, i) if ends else (i, last)
        number = {spelled: i + 1 for i, spelled in enumerate(self._tokens)} | {b"": 0}
        steps = sorted((number[s[:-1]] * 256 + s[-1], number[s]) for s in self._tokens)
        self._steps, self._next = (np.array(c, np.int64) for c in zip(*steps))
        self._inner, self._last = (np.array([-1, *c], np.int64) for c in zip(*self._tokens.values()))

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many distinct pre-split words, each on the one accepted path that spells it.

        All tokens that begin at any place are found first; then the paths grow from the left, one place
        of every word at a time, and the last arcs are followed back.
        """
        short = [p for p in pieces if len(p) <= LONGEST_TOGETHER]
        if not short:
            return [self.piece(p) for p in pieces]
        data = np.frombuffer(b"".join(short), np.uint8)
        size = np.array([len(p) for p in short], np.int64)
        word = np.repeat(np.arange(len(short)), size)
        first = np.cumsum(size) - size
        stop = (first + size)[word]
        at, node, arcs = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for n in range(1, LONGEST_TOGETHER + 1):
            key = node * 256 + data[at + n - 1]
            k = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            known = self._steps[k] == key
            at, node = at[known], self._next[k[known]]
            ends = at + n == stop[at]
            token = np.where(ends, self._last[node], self._inner[node])
            some = token >= 0
            arcs.append((at[some], at[some] + n, token[some]))
            at, node = at[~ends], node[~ends]
            if not len(at):
                break
        begin, end, token = (np.concatenate(c) for c in zip(*arcs))
        # Every word has a place more than it has bytes.
        begin, end, depth = begin + word[begin], end + word[begin], begin - first[word[begin]]
        order = np.argsort(depth, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        bounds = np.searchsorted(depth[order], np.arange(int(size.max()) + 1))
        state = np.full(len(data) + len(short), -1, np.int64)
        state[first + np.arange(len(short))] = 0
        came, by = np.zeros_like(state), np.zeros_like(state)
        for lo, hi in zip(bounds, bounds[1:]):
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            good = state[b] >= 0
            good[good] = self.automaton.have_arcs(state[b[good]], t[good])
            b, e, t = b[good], e[good], t[good]
            state[e], came[e], by[e] = self.automaton.go(t), b, t
        rows, place = np.arange(len(short)), first + size + np.arange(len(short))
        start, found = first + rows, []
        while len(rows):
            found.append((rows, by[place]))
            place = came[place]
            go = place > start[rows]
            rows, place = rows[go], place[go]
        rows, ids = (np.concatenate(c) for c in zip(*reversed(found)))
        ids = ids[np.argsort(rows, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(rows, minlength=len(short))).tolist()
        together = iter([ids[a:b] for a, b in zip([0, *ends], ends)])
        return [next(together) if len(p) <= LONGEST_TOGETHER else self.piece(p) for p in pieces]

    def piece(self, piece: bytes) -> list[int]:
        """The ids on the one accepted path that spells a pre-split word.

        Long arcs are tried first. As every prefix has one path only, a place that leads no further once
        never does, so the search takes linear time.
        """
        tokens, target, has_arc = self._tokens.get, self.automaton.target, self.automaton.has_arc
        n = len(piece)
        ids: list[int] = []
        begins: list[int] = []
        choices: list[list[tuple[int, int]]] = []
        closed: set[int] = set()
        at = state = 0
        while at < n:
            arcs = []
            for j in range(at + 1, n + 1):
                found = tokens(piece[at:j])
                if found is None:
                    break
                t = found[j == n]
                if t >= 0:
                    arcs.append((t, j))
            begins.append(at)
            choices.append(arcs)
            while True:
                if not arcs:
                    closed.add(begins.pop())
                    choices.pop()
                    arcs = choices[-1]
                    ids.pop()
                    state = target[ids[-1]] if ids else 0
                    continue
                t, j = arcs.pop()
                if j not in closed and has_arc(state, t):
                    break
            ids.append(t)
            at, state = j, target[t]
        return ids

    #: Texts of these characters are in normal form, and their letters are known.
    _PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")

    def _presplit(self, text: str) -> list[str]:
        """Words of a text without special tokens, in normal form."""
        if text.isascii() and not self._RARE.search(text) or self._PLAIN.fullmatch(text):
            return self._SPLIT.findall(text.lower())
        normal = self._tokenizer.normalizer.normalize_str(text)
        split = self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes([self._byte[c] for c in letters]).decode() for letters, _ in split]

    #: Control characters that aren't white space.
    _RARE = re.compile("[\x00-\x08\x0e-\x1f\x7f]")

    def words(self, text: str) -> list[str | int]:
        """Pre-split words of a text, and the ids of the special tokens between them."""
        if self._special_text is None or "<" not in text:
            return self._presplit(text)
        words: list[str | int] = []
        for part in self._special_text.split(text):
            if part in self._special:
                words.append(self._special[part])
            elif part:
                words += self._presplit(part)
        return words

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as the tokenizers library joins them; ids without a label are left out."""
        labels = self.labels
        return " ".join([labels[i] for i in ids if i in labels])

    def _coded(self, words: set[str | int]) -> dict[str | int, tuple[bytes, str]]:
        """Ids, as little-endian 32-bit numbers, and labels of words; those met lately are kept."""
        found, new = {}, []
        for w in words:
            row = self._kept.get(w) or self._older.get(w)
            if row is None:
                new.append(w)
            else:
                found[w] = row
        for at in range(0, len(new), MOST_TOGETHER):
            some = [w for w in new[at : at + MOST_TOGETHER] if w.__class__ is str]
            for w, ids in zip(some, self.pieces([w.encode() for w in some])):
                found[w] = struct.pack(f"<{len(ids)}i", *ids), self.decode(ids)
        for i in self._special.values():
            found[i] = struct.pack("<i", i), self.labels[i]
        if len(self._kept) + len(new) > KEPT_WORDS:
            self._older, self._kept = self._kept, {}
        self._kept.update((w, found[w]) for w in words if w.__class__ is str and len(w) <= LONGEST_KEPT)
        return found

    def texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of whole texts, as little-endian 32-bit numbers, and the labels on their paths."""
        split = [self.words(text) for text in texts]
        found = self._coded(set().union(*split))
        out = []
        for words in split:
            rows = [found[w] for w in words]
            out.append((b"".join([ids for ids, _ in rows]), " ".join([labels for _, labels in rows])))
        return out


def codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary, one per worker."""
    return _loaded("automaton of " + vocabulary, lambda _: (Codec(_path(vocabulary)),))[0]


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the labels of the ids, of every whole text.

    Ids are those of the tokenizers library without special tokens at the ends; the text of a special
    token is its id. Null and empty texts have no ids; repeated rows and null ids stay rows of their own;
    an empty table gives no rows; other columns of ``df``, whatever their names, are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(vocabulary)
        for batch in batches:
            for part in _by_size(batch):
                ids, decoded = zip(*words.texts([raw or "" for raw in part.column(1).to_pylist()]))
                columns = [part.column(0), _lists(ids), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    columns = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def _lists(ids: list[bytes]) -> pa.Array:
    """Little-endian 32-bit numbers as one column of lists."""
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``TOGETHER_BYTES`` of text; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + TOGETHER_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``decoded`` and ``canonical`` of every row of ids.

    Ids that the vocabulary lacks have no label and are left out; null ids are none. ``canonical`` tells
    whether the ids are a path of the automaton, that is, whether the merges leave them as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(vocabulary)
        for batch in batches:
            rows = [[] if r is None else [t for t in r if t is not None] for r in batch.column(1).to_pylist()]
            decoded = [words.decode(r) for r in rows]
            canonical = [words.automaton.accepts(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(decoded, pa.string()), pa.array(canonical, pa.bool_())], schema=_DECODED
            )

    columns = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return columns.mapInArrow(run, "doc_id bigint, decoded string, canonical boolean")
