"""Sum-of-squares packing of token ids into windows of equal length.

Each task packs its own rows as they arrive, without a shuffle. A document's ids are cut into whole windows and a rest;
the rest goes to the fill level that makes the sum of the squared numbers of partly filled windows smallest, counted in
an array by level. When too many windows are open, and at the end of the partition, open windows are closed: the fullest
are filled up with ids cut from the emptiest, so that a partition pads one window at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from talkloom.llm.tables import map_rows, utf8
from talkloom.llm.tokens import END_ID, encoder, widened

WINDOW = 2048
# Windows a task holds open; beyond, half of them are closed. Bounds a task's memory at this many windows.
OPEN_WINDOWS = 8192

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)

# A piece: document, ids of the document before it, ids of the whole document, the ids as an array.
Piece = tuple


class SquaresPacker:
    """Windows of one task. `add` and `close` give the windows that are finished, as lists of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.open_windows = window, open_windows
        self.counts = np.zeros(window + 1, np.int64)  # windows by level; full ones aren't counted
        self._open: dict[int, list[list[Piece]]] = {}

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[Piece]]:
        n = len(ids)
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            yield [(doc_id, at, n, ids[at : at + self.window])]
        if whole < n:
            yield from self._place((doc_id, whole, n, ids[whole:].copy()))
        if self.counts.sum() > self.open_windows:
            yield from self._merge(self.open_windows // 2)

    def level_for(self, size: int) -> int:
        """Level whose window takes `size` ids so that the sum of squares grows least; 0 is a new window. Of equal
        ones, the fullest."""
        top = self.window - size
        here = self.counts[1 : top + 1]
        if not here.any():
            return 0
        growth = 1 - 2 * here
        growth[:-1] += 2 * self.counts[1 + size : self.window] + 1  # the window moves to a level that isn't full
        growth[here == 0] = np.iinfo(np.int64).max
        best = len(growth) - 1 - int(growth[::-1].argmin())
        return best + 1 if growth[best] <= 2 * self.counts[size] + 1 else 0

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        level = self.level_for(len(piece[3]))
        pieces = self._take(level) if level else []
        pieces.append(piece)
        yield from self._put(pieces, level + len(piece[3]))

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        return self._open[level].pop()

    def _put(self, pieces: list[Piece], level: int) -> Iterator[list[Piece]]:
        if level == self.window:
            yield pieces
        else:
            self.counts[level] += 1
            self._open.setdefault(level, []).append(pieces)

    def _merge(self, keep: int) -> Iterator[list[Piece]]:
        """Fill the fullest windows from the emptiest until `keep` are open."""
        levels = np.repeat(np.arange(len(self.counts)), self.counts)
        low, high = 0, len(levels) - 1
        source: list[Piece] = []
        while high - low + bool(source) >= max(keep, 1) and low <= high:
            target, level = self._take(int(levels[high])), int(levels[high])
            high -= 1
            while level < self.window:
                if not source:
                    if low > high:
                        break
                    source = self._take(int(levels[low]))
                    low += 1
                doc_id, start, total, ids = source.pop()
                part = ids[: self.window - level]
                target.append((doc_id, start, total, part))
                level += len(part)
                if len(part) < len(ids):
                    source.append((doc_id, start + len(part), total, ids[len(part) :]))
            yield from self._put(target, level)
        if source:
            yield from self._put(source, sum(len(p[3]) for p in source))

    def close(self) -> Iterator[list[Piece]]:
        yield from self._merge(1)
        for level in np.flatnonzero(self.counts):
            for _ in range(self.counts[level]):
                yield self._take(int(level))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of the documents with their place in a sequence, one row each.

    Columns: doc_id, start (the document's ids before the piece), length, doc_tokens (ids of the whole document with the
    end id), sequence_id, offset (of the piece in its sequence), ids (little-endian unsigned 32-bit integers). Every id
    of every document is in exactly one piece, and a sequence's pieces follow each other without a gap.

    A null or empty text has the end id alone. A null doc_id is carried along. Repeated rows are packed one by one. An
    empty table gives no rows. Other columns are not read. A partition's result depends on its own rows only, so a task
    that runs again on them gives the same sequences.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        encode = encoder(tokenizer, end_id)
        packer = SquaresPacker(window, open_windows)
        number = TaskContext.get().partitionId() << 33

        def finished() -> Iterator[list[Piece]]:
            for key, data in rows:
                yield from packer.add(key, np.frombuffer(encode(data), encode.dtype))
            yield from packer.close()

        for pieces in finished():
            offset = 0
            for key, start, total, ids in pieces:
                yield key, start, len(ids), total, number, offset, widened(ids.tobytes(), encode.dtype)
                offset += len(ids)
            number += 1
        encode.forget()

    keyed = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("binary").alias("text"))
    return map_rows(keyed, run, PIECES)
