"""Katz backoff language model: Good-Turing discounted bigrams over discounted words.

Tokens are the words of a text, A-Z in lower case, and one end token. A word that follows history h has
the probability d(c) * c(h, w) / c(h) if the pair was learned, else a(h) * p(w); p(w) is d(c) * c(w) / N,
and what the discounts leave goes to the one class of unknown words. d is Katz's discount from the
counts of counts up to ``MOST_DISCOUNTED``; a(h) is the mass that h's pairs leave over the mass that
p leaves to all other words, so the probabilities after any history sum to 1. Where no pair of a
history is discounted, the history counts once more, and that one is what it leaves. Unknown histories
leave everything to p.

The corpus is cut into blocks of ``BLOCK_TOKENS``, as they lie. Tables and messages are columns of
whole arrays, packed into binary values, so that tasks work on arrays rather than on tokens:

* ``blocks``: tokens as places in the block's list of different words, which is ordered by their hashes;
* ``words``: partitioned by word, the merged counts; each block gets its words' counts and ids back;
* ``pairs``: partitioned by history, the merged counts of pairs; a history that would fill more than
  one ``HOT_SHARE``th of a partition is spread over as many partitions as that takes, by the other word. They are evaluated where they are
  merged, since each block sends with a pair the documents that hold it: back come sums by document;
* ``histories``: what each history's pairs weigh, summed over the partitions, and its a(h). What wasn't
  learned is joined to it by history.

Every token of every document so goes through the recursion pair, history, word, unknown once. Sizes of
blocks and partitions are fixed; their number grows with the corpus. The driver sees counts of counts.

Null texts are empty: one end token. Rows of one doc_id are scored and learned each, a null id counts as
the empty text for the split, an empty table gives none; with nothing to learn from every token is
unknown, with probability 1. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

BLOCK_TOKENS = 1 << 20
#: Tokens whose words, or pairs, are merged by one task.
PART_TOKENS = 2 << 20
#: A history with more tokens than one in so many of ``PART_TOKENS`` is spread.
HOT_SHARE = 8
MOST_DISCOUNTED = 5
#: Stands for the start of a text as a history.
_START = (1 << 62) - 1

_BLOCKS = (
    "block bigint, n_tokens bigint, n_words bigint, learned bigint, texts bigint, doc_ids array<bigint>, held binary, "
    "sizes binary, words binary, tokens binary"
)
_WORDS = "part bigint, block bigint, words binary, counts binary"
_FOUND = "part bigint, block bigint, ids binary, counts binary, summary array<bigint>"
_PAIRS = (
    "kind string, part bigint, block bigint, doc_ids array<bigint>, a binary, b binary, c binary, d binary, e binary, "
    "f binary, g binary"
)


def squeeze(values) -> bytes:
    """An array as bytes, by byte planes: small numbers leave planes of zeros."""
    import numpy as np
    from zstandard import ZstdCompressor

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(packed: bytes, dtype):
    import numpy as np
    from zstandard import ZstdDecompressor

    kind = np.dtype(dtype)
    planes = np.frombuffer(ZstdDecompressor().decompress(packed), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def discounts(counts: list[int]) -> list[float]:
    """d(1) to d(k) from the counts of counts 1 to k + 1.

    Katz's formula where it gives discounts between 0 and 1, else absolute discounting.
    """
    k = len(counts) - 1
    common = (k + 1) * counts[k] / counts[0] if counts[0] else 1.0
    if common < 1 and all(counts[:k]):
        found = [((r + 1) * counts[r] / (r * counts[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return found
    off = counts[0] / (counts[0] + 2 * counts[1]) if counts[0] and counts[1] else 0.5
    return [(r - off) / r for r in range(1, k + 1)]


class Words:
    """Word probabilities from counts: ``total`` tokens of ``distinct`` words learned in ``texts`` texts."""

    def __init__(self, total: int, texts: int, distinct: int, counts: list[int]):
        self.total, self.texts, self.distinct = total, texts, distinct
        self.d = discounts(counts)
        left = sum((1 - d) * r * n for r, d, n in zip(range(1, len(counts)), self.d, counts))
        # Without small counts nothing is left for unknown words; then every word counts once more.
        self.once_more = left <= 0
        self.unknown = 1 / (total + distinct + 1) if self.once_more else left / total

    def of(self, counts):
        import numpy as np

        counts = np.asarray(counts, float)
        if self.once_more:
            return (counts + 1) / (self.total + self.distinct + 1)
        d = np.array([0.0, *self.d, 1.0])[np.minimum(counts, len(self.d) + 1).astype(int)]
        return np.where(counts > 0, d * counts / self.total, self.unknown)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def blocks(df: DataFrame, doc_id: str, text: str, held_out: Column, block_tokens: int) -> DataFrame:
    """The corpus in blocks: documents, their sizes, different words by hash and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        number = TaskContext.get().partitionId() << 32
        # No word has a line break, so the end token is one.
        places, tokens, ids, held, sizes = {b"\n": 0}, [], [], [], []

        def flush() -> pa.RecordBatch:
            size, out = np.array(sizes, np.uint64), np.array(held, bool)
            words = np.array([xxh64_intdigest(w) for w in places], np.uint64)
            order = np.argsort(words)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            row = (
                number, len(tokens), len(words), int(size[~out].sum()), int((~out).sum()), ids, out.tobytes(), squeeze(size),
                squeeze(np.diff(words[order], prepend=np.uint64(0))), squeeze(place[tokens]),
            )
            return _batch([row], _BLOCKS)

        for batch in batches:
            for i, raw, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = (raw.as_py() or b"").lower().split()
                tokens += [places.setdefault(w, len(places)) for w in words]
                tokens.append(0)
                ids.append(i)
                held.append(out)
                sizes.append(len(words) + 1)
                if len(tokens) >= block_tokens:
                    yield flush()
                    number += 1
                    places, tokens, ids, held, sizes = {b"\n": 0}, [], [], [], []
        if ids:
            yield flush()

    columns = df.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).cast("binary").alias("t"), held_out.alias("h"))
    return columns.mapInArrow(run, _BLOCKS)


def _learned_counts(row: dict):
    """Of a block: tokens, sizes of documents, held-out flags, and how often each word was learned."""
    import numpy as np

    tokens, sizes = unsqueeze(row["tokens"], np.uint32).astype(np.int64), unsqueeze(row["sizes"], np.uint64).astype(np.int64)
    held = np.frombuffer(row["held"], bool)
    counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=row["n_words"])
    return tokens, sizes, held, counts


def _parts(words, parts: int):
    """Where each partition begins in a block's ordered words: partitions are ranges of hashes."""
    import numpy as np

    part = (words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1))


def _send_words(cut: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, counts = _learned_counts(row)
                words = np.cumsum(unsqueeze(row["words"], np.uint64), dtype=np.uint64)
                at = _parts(words, parts)
                rows = []
                for p in range(parts):
                    some = slice(at[p], at[p + 1])
                    if at[p] < at[p + 1]:
                        steps = np.diff(words[some], prepend=np.uint64(0))
                        rows.append((p, row["block"], squeeze(steps), squeeze(counts[some].astype(np.uint64))))
                yield _batch(rows, _WORDS)

    return cut.select(*[x.split()[0] for x in _BLOCKS.split(", ")]).mapInArrow(run, _WORDS)


def _merge_words(sent: DataFrame, parts: int) -> DataFrame:
    """For each block and partition the ids and counts of its words; once per partition its summary."""

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        part = rows[0]["part"]
        each = [np.cumsum(unsqueeze(r["words"], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(x) for x in each])
        words = np.concatenate(each)
        counts = np.concatenate([unsqueeze(r["counts"], np.uint64) for r in rows]).astype(np.int64)
        _, which = np.unique(words, return_inverse=True)
        total = np.zeros(which.max() + 1, np.int64)
        np.add.at(total, which, counts)
        rank = np.empty(len(total), np.uint64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids = rank * np.uint64(parts) + np.uint64(part)
        out = []
        for r, first, last in zip(rows, [0, *ends[:-1]], ends):
            some = which[first:last]
            out.append((part, r["block"], squeeze(ids[some]), squeeze(total[some].astype(np.uint64)), None))
        of_counts = np.bincount(np.minimum(total, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        summary = [int((total > 0).sum()), *of_counts[1 : MOST_DISCOUNTED + 2].tolist()]
        out.append((part, None, None, None, summary))
        return pa.Table.from_batches([_batch(out, _FOUND)])

    return sent.groupBy("part").applyInArrow(merge, _FOUND)


def _send_pairs(known: DataFrame, words: Words, hot: int, pair_parts: int) -> DataFrame:
    """From blocks with their words' ids and counts: sums by document, and pairs by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens, sizes, held, _ = _learned_counts(row)
                found = sorted(row["found"], key=lambda x: x["part"])
                ids = np.concatenate([unsqueeze(x["ids"], np.uint64) for x in found])
                counts = np.concatenate([unsqueeze(x["counts"], np.uint64) for x in found]).astype(np.int64)

                starts = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(sizes)), sizes)
                c = counts[tokens]
                base = np.add.reduceat(np.log10((c + 1) / (words.total + words.distinct + 1)), starts)
                alone = np.add.reduceat(np.log10(words.of(c)), starts)
                n_known = np.add.reduceat((c > 0).astype(np.int64), starts)
                yield _batch([(
                    "documents", row["block"] % pair_parts, row["block"], row["doc_ids"], row["held"], squeeze(sizes),
                    squeeze(n_known), squeeze(base), squeeze(alone), None, None,
                )], _PAIRS)

                # The history of a text's first token is its start, which was learned once for each learned text.
                history = np.empty(len(tokens), np.uint64)
                history[1:] = ids[tokens[:-1]]
                history[starts] = _START
                times = np.empty(len(tokens), np.int64)
                times[1:] = c[:-1]
                times[starts] = words.texts
                usable = times > 0
                yield from _pair_rows(
                    row["block"], history[usable], ids[tokens][usable], times[usable], c[usable],
                    doc[usable], ~held[doc[usable]], hot, pair_parts,
                )

    return known.mapInArrow(run, _PAIRS)


def _pair_rows(block, history, word, times, count, doc, learned, hot: int, pair_parts: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a block by partition: different ones with counts, then the documents that hold them."""
    import numpy as np

    spread = word % (times // hot + 1).astype(np.uint64)
    mixed = (history + spread * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(pair_parts)).astype(np.int64)
    order = np.lexsort((doc, word, history, part))
    history, word, times, count, doc, learned, part = (x[order] for x in (history, word, times, count, doc, learned, part))
    at = np.searchsorted(part, np.arange(pair_parts + 1))
    rows = []
    for p in range(pair_parts):
        s = slice(at[p], at[p + 1])
        h, w = history[s], word[s]
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        uses = np.diff(np.append(first, len(h)))
        n = np.add.reduceat(learned[s].astype(np.int64), first)
        steps = np.diff(h[first], prepend=np.uint64(0))
        rows.append((
            "pairs", p, block, None, squeeze(steps), squeeze(w[first]), squeeze(times[s][first]), squeeze(count[s][first]),
            squeeze(n), squeeze(uses), squeeze(doc[s].astype(np.uint32)),
        ))
    yield _batch(rows, _PAIRS)


def _merge_pairs(sent: DataFrame, words: Words, hot: int) -> DataFrame:
    """Merged pairs of each partition and what follows from them.

    ``documents`` rows pass. ``model``: histories, words, counts. ``histories``: counts of counts of
    pairs, larger counts' sum, mass in p and count of each history. ``sums``: by block and document the
    logs of learned pairs without discount, less the words' own, and how often each discount applies.
    ``missing``: by block, the histories of pairs that weren't learned, with documents.
    """

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        out = [tuple(r.values()) for r in rows if r["kind"] == "documents"]
        rows = [r for r in rows if r["kind"] == "pairs"]
        if not rows:
            return pa.Table.from_batches([_batch(out, _PAIRS)])
        part = rows[0]["part"]
        each = [np.cumsum(unsqueeze(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(x) for x in each])
        history = np.concatenate(each)

        def column(name: str, kind=np.int64):
            return np.concatenate([unsqueeze(r[name], kind) for r in rows])

        word = column("b", np.uint64)
        order = np.lexsort((word, history))
        new = np.concatenate([[True], (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)])
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        history_of, word_of = history[first], word[first]
        del each, history, word, order, new
        times_of, count_of = column("c")[first], column("d")[first]
        total = np.zeros(len(first), np.int64)
        np.add.at(total, which, column("e"))
        uses = column("f")
        alone = words.of(count_of)

        learned = total > 0
        begins = np.flatnonzero(np.concatenate([[True], history_of[1:] != history_of[:-1]]))
        capped = np.where(learned, np.minimum(total, MOST_DISCOUNTED + 2), 0)
        of_counts = [np.add.reduceat((capped == r).astype(np.int64), begins) for r in range(1, MOST_DISCOUNTED + 2)]
        larger = np.add.reduceat(np.where(total > MOST_DISCOUNTED, total, 0), begins)
        mass = np.add.reduceat(np.where(learned, alone, 0.0), begins)
        out.append((
            "histories", part, None, None, squeeze(history_of[begins]), squeeze(np.stack(of_counts, axis=1).reshape(-1)),
            squeeze(larger), squeeze(mass), squeeze(times_of[begins]), None, None,
        ))
        steps = np.diff(history_of[learned], prepend=np.uint64(0))
        out.append(("model", part, None, None, squeeze(steps), squeeze(word_of[learned]), squeeze(total[learned]), *[None] * 4))

        # A history counts once more where none of its pairs is discounted. Of a spread one that isn't known here
        # if none is discounted here; then its pairs wait for the sums over all partitions.
        low = sum(of_counts[:MOST_DISCOUNTED])
        size = np.diff(np.append(begins, len(history_of)))
        none_here, spread = np.repeat((low == 0), size), times_of >= hot
        more, waits = none_here & ~spread, none_here & spread
        with np.errstate(divide="ignore"):
            gain = np.log10(total / (times_of + more)) - np.log10(alone)
        for r, a, b in zip(rows, [0, *ends[:-1]], ends):
            pair = np.repeat(which[a:b], uses[a:b])
            doc = unsqueeze(r["g"], np.uint32).astype(np.int64)
            known = learned[pair]
            docs = np.unique(doc[known])
            place = np.searchsorted(docs, doc[known])
            sums = np.bincount(place, weights=gain[pair[known]], minlength=len(docs))
            capped_at = np.minimum(total[pair[known]], MOST_DISCOUNTED + 1)
            applied = np.bincount(place * (MOST_DISCOUNTED + 1) + capped_at - 1, minlength=len(docs) * (MOST_DISCOUNTED + 1))
            sums_of = (squeeze(docs.astype(np.uint32)), squeeze(sums), squeeze(applied.astype(np.uint32)))
            out.append(("sums", part, r["block"], None, *sums_of, *[None] * 4))
            for kind, those in (("missing", ~known), ("waiting", known & waits[pair])):
                if those.any():
                    counted = _counted(history_of[pair[those]], doc[those].astype(np.uint32))
                    out.append((kind, part, r["block"], None, *map(squeeze, counted), *[None] * 4))
        return pa.Table.from_batches([_batch(out, _PAIRS)])

    return sent.groupBy("part").applyInArrow(merge, _PAIRS)


def _histories(merged: DataFrame) -> DataFrame:
    """``history, n1 .. n6, larger, mass, times`` summed over the partitions that share a history."""
    names = [f"n{r}" for r in range(1, MOST_DISCOUNTED + 2)]
    schema = f"history bigint, {', '.join(f'{n} bigint' for n in names)}, larger bigint, mass double, times bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                counts = unsqueeze(r["b"], np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unsqueeze(r["a"], np.int64)), *[pa.array(counts[:, i]) for i in range(len(names))],
                     pa.array(unsqueeze(r["c"], np.int64)), pa.array(unsqueeze(r["d"], np.float64)), pa.array(unsqueeze(r["e"], np.int64))],
                    names=["history", *names, "larger", "mass", "times"],
                )

    rows = merged.filter("kind = 'histories'").select("a", "b", "c", "d", "e").mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in (*names, "larger", "mass")]
    return rows.groupBy("history").agg(*sums, F.max("times").alias("times"))


def _counted(history, doc):
    """The different pairs of history and document, and how often each occurs."""
    import numpy as np

    order = np.lexsort((doc, history))
    history, doc = history[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (history[1:] != history[:-1]) | (doc[1:] != doc[:-1])]))
    return history[first], doc[first], np.diff(np.append(first, len(history))).astype(np.uint32)


def _by_history(merged: DataFrame, kind: str) -> DataFrame:
    """``history, block, doc, n``: how many pairs of a kind, those that weren't learned or those that wait for the
    history's sums, a document has after a history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                history, doc = unsqueeze(r["a"], np.int64), unsqueeze(r["b"], np.uint32).astype(np.int64)
                n = unsqueeze(r["c"], np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(history), pa.array(np.full(len(doc), r["block"])), pa.array(doc), pa.array(n)],
                    names=["history", "block", "doc", "n"],
                )

    rows = merged.filter(F.col("kind") == kind).select("block", "a", "b", "c")
    each = rows.mapInArrow(run, "history bigint, block bigint, doc bigint, n bigint")
    return each.groupBy("history", "block", "doc").agg(F.sum("n").alias("n"))


def _document_sums(merged: DataFrame, d: list[float]) -> DataFrame:
    """``block, doc, gained``: what learned pairs add to the words' own logs."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pylist()
        doc = np.concatenate([unsqueeze(r["a"], np.uint32).astype(np.int64) for r in rows])
        gain = np.concatenate([unsqueeze(r["b"], np.float64) for r in rows])
        applied = np.concatenate([unsqueeze(r["c"], np.uint32).astype(np.int64) for r in rows]).reshape(-1, MOST_DISCOUNTED + 1)
        gain = gain + applied[:, :-1] @ np.log10(np.array(d))
        sums = np.bincount(doc, weights=gain)
        at = np.unique(doc)
        return pa.table({"block": np.full(len(at), rows[0]["block"]), "doc": at, "gained": sums[at]})

    rows = merged.filter("kind = 'sums'").select("block", "a", "b", "c")
    return rows.groupBy("block").applyInArrow(run, "block bigint, doc bigint, gained double")


def _documents(merged: DataFrame) -> DataFrame:
    schema = "block bigint, doc bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, alone double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["doc_ids"])
                columns = [
                    np.full(n, r["block"]), np.arange(n), pa.array(r["doc_ids"], pa.int64()), np.frombuffer(r["a"], bool),
                    unsqueeze(r["b"], np.int64), unsqueeze(r["c"], np.int64), unsqueeze(r["d"], np.float64), unsqueeze(r["e"], np.float64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    return merged.filter("kind = 'documents'").select("block", "doc_ids", "a", "b", "c", "d", "e").mapInArrow(run, schema)


def scores(
    df: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    part_tokens: int = PART_TOKENS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row.

    Rows where ``held_out`` isn't true are learned from. Scores are log10 probabilities of whole texts;
    ``base_score`` is that of single words, each counted once more.
    """
    cut = stored(blocks(df, doc_id, text, F.coalesce(held_out, F.lit(False)), block_tokens), "blocks")
    sums = cut.agg(F.sum("n_tokens").alias("n"), F.sum("learned").alias("learned"), F.sum("texts").alias("texts")).collect()[0]
    total, parts = sums["learned"] or 0, (sums["n"] or 0) // part_tokens + 1
    found = stored(_merge_words(_send_words(cut, parts), parts), "words")
    heads = [F.sum(F.col("summary")[i]).alias(f"s{i}") for i in range(MOST_DISCOUNTED + 2)]
    summary = [x or 0 for x in found.filter("block IS NULL").agg(*heads).collect()[0]]
    words = Words(total, sums["texts"] or 0, summary[0], summary[1:])
    hot = max(part_tokens // hot_share, 1)

    of_block = found.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "ids", "counts")).alias("found"))
    # The words' hashes have done their work; the counts come back in their order.
    sent = _send_pairs(cut.drop("words").join(of_block, "block"), words, hot, parts)
    merged = stored(_merge_pairs(sent, words, hot), "pairs")

    histories = stored(_histories(merged), "histories")
    names = [f"n{r}" for r in range(1, MOST_DISCOUNTED + 2)]
    d = discounts([x or 0 for x in histories.agg(*[F.sum(n) for n in names]).collect()[0]])
    taken = sum((F.col(n) * (r * x) for r, (n, x) in enumerate(zip(names, d), 1)), F.lit(0.0)) + F.col("larger")
    low = sum((F.col(n) for n in names[1:MOST_DISCOUNTED]), F.col(names[0]))
    times = F.col("times") + F.when(low == 0, 1).otherwise(0)
    weights = histories.select("history", F.log10((1 - taken / times) / (1 - F.col("mass"))).alias("weight"))
    once_more = histories.filter(low == 0).select("history", F.log10(F.col("times") / (F.col("times") + 1)).alias("weight"))
    left = (
        _by_history(merged, "missing")
        .join(weights, "history")
        .unionByName(_by_history(merged, "waiting").join(once_more, "history"))
        .groupBy("block", "doc")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("left"))
    )
    joined = _documents(merged).join(_document_sums(merged, d), ["block", "doc"], "left").join(left, ["block", "doc"], "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score",
        (F.col("alone") + F.coalesce("gained", F.lit(0.0)) + F.coalesce("left", F.lit(0.0))).alias("score"),
    )
