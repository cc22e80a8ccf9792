"""Sum-of-squares online packing of token sequences into windows of fixed capacity.

A window with ``h`` of ``capacity`` tokens has level ``h``, and ``N(h)`` counts the open windows of a
level. Each arriving piece goes to the level that leaves the smallest sum of ``N(h)**2`` over the
partially filled levels, a new window included; full windows leave. The counts are one array, so a
piece costs one vector operation over the levels, whatever has been packed before.

Documents of ``capacity`` tokens and more first give full windows; what remains of them is placed as
above. Each partition packs its own rows in their order, without a shuffle and with at most
``MAX_OPEN`` open windows. When that many are open, and at the end, the open windows are closed:
the emptiest give their pieces, cut where needed, to the fullest, until one is left, which is cut into
windows of a power of two, since those aren't padded.

Null texts are empty; an empty text is the end token alone; repeated rows are packed once each; an
empty table gives no pieces; the doc_id may be null. Windows never hold the rows of two partitions, so
a lost task is repeated with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Open windows that a task keeps at most; beyond, they are closed by cutting.
MAX_OPEN = 4096
#: Windows of one partition are numbered from partition * 2**40.
_PARTITION_BITS = 40

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])


class Levels:
    """Open windows by level and the choice of the level for a piece."""

    def __init__(self, capacity: int):
        import numpy as np

        self.np = np
        self.capacity = capacity
        # What leaving level h changes in the sum of squares, and what entering it changes.
        self.leave = np.full(capacity + 1, np.inf)
        self.enter = np.ones(capacity + 1)
        self.enter[capacity] = 0
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def choose(self, size: int) -> int:
        """The level to which a piece of ``size`` tokens goes; 0 is a new window. Ties: the fullest."""
        cost = self.leave[1 : self.capacity - size + 1] + self.enter[size + 1 :]
        if not len(cost):
            return 0
        best = len(cost) - 1 - int(self.np.argmin(cost[::-1]))
        return best + 1 if cost[best] <= self.enter[size] else 0

    def _count(self, level: int) -> None:
        n = len(self.windows[level])
        self.leave[level] = 1 - 2 * n if n else self.np.inf
        self.enter[level] = 2 * n + 1

    def take(self, level: int) -> int:
        window = self.windows[level].pop()
        self._count(level)
        self.open -= 1
        return window

    def put(self, window: int, level: int) -> None:
        if level < self.capacity:
            self.windows[level].append(window)
            self._count(level)
            self.open += 1


class Packer:
    """Packs the documents of one partition. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, capacity: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.capacity = capacity
        self.max_open = max_open
        self.next = first_sequence
        self.levels = Levels(capacity)
        self.content: dict[int, list] = {}
        self.out: list[list] = [[] for _ in _ARROW]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, sequence: int, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            for column, value in zip(self.out, (doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence, offset)):
                column.append(value)
            offset += n

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.capacity
        whole = len(ids) - len(ids) % width
        for at in range(0, whole, width):
            self._emit(self._new(), [(doc_id, at // 4, ids[at : at + width], total)])
        if whole < len(ids):
            self._place((doc_id, whole // 4, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self.levels.choose(size)
        window = self.levels.take(level) if level else self._new()
        self.content.setdefault(window, []).append(piece)
        self.levels.put(window, level + size)
        if level + size == self.capacity:
            self._emit(window, self.content.pop(window))
        elif self.levels.open >= self.max_open:
            self.close()

    def close(self) -> None:
        """Closes all open windows."""
        filled = [(sum(len(p[2]) for p in pieces), w) for w, pieces in self.content.items()]
        order = [w for _, w in sorted(filled, key=lambda x: (-x[0], x[1]))]
        pieces = [p for w in order for p in self.content[w]]
        self.content, self.levels = {}, Levels(self.capacity)
        left = sum(len(p[2]) for p in pieces) // 4
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            for doc_id, start, ids, total in self._first(pieces, 4 * room):
                window.append((doc_id, start, ids, total))
            self._emit(self._new(), window)

    @staticmethod
    def _first(pieces: list, room: int) -> list:
        """Takes ``room`` bytes: whole pieces from the fullest windows, then as many as needed from the emptiest."""
        taken = []
        while room and pieces and len(pieces[0][2]) <= room:
            taken.append(pieces.pop(0))
            room -= len(taken[-1][2])
        while room:
            doc_id, start, ids, total = pieces.pop()
            taken.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                pieces.append((doc_id, start + room // 4, ids[room:], total))
            room -= len(ids[:room])
        return taken

    def batch(self) -> pa.RecordBatch:
        columns, self.out = self.out, [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """The pieces of all documents, one row each: see the module and ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioscope.llm.vocabulary import word_bpe

        words = word_bpe(vocabulary)
        end = end_id.to_bytes(4, "little")
        packer = Packer(capacity, TaskContext.get().partitionId() << _PARTITION_BITS, max_open)
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), words.of_texts(batch.column(1))):
                packer.add(i, ids + end)
            yield packer.batch()
        packer.close()
        yield packer.batch()

    columns = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return columns.mapInArrow(run, SCHEMA)
