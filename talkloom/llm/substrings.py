"""Removal of repeated passages, found by anchors at the positions of a difference cover.

A window is SPAN consecutive words. Anchors are hashes of short windows that begin at document positions whose remainder
modulo PERIOD is in COVER. The differences of COVER give every remainder, so two equal windows, wherever they begin, hold
an equal anchor at the same distance from their beginnings. Anchors that occur twice are found first; only windows around
them are then compared in full, and each word in a window that also begins earlier is removed.

Hashes are compared by `exchange`, so that no window is a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from talkloom.llm.exchange import bits, blocks_of, exchange, n_buckets_for, not_first, order_of, slices, twice
from talkloom.llm.tables import map_rows
from talkloom.llm.words import SPACED, windows, words
from talkloom.runtime import lookup_join

SPAN = 20
# A perfect difference set: each remainder but 0 is the difference of one pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
# Bytes of a usual word, for the number of buckets only.
WORD_BYTES = 6
ANCHOR = SPAN - PERIOD + 1  # words; a window holds an anchor at every one of PERIOD distances


class _Block:
    """Windows of a block's documents, which are in the order of their ids."""

    def __init__(self, row: tuple):
        self.doc_ids, self.row_keys, self.texts = row[1], row[2], row[3]
        self.order = order_of(self.doc_ids)
        self.words = words(self.texts, SPACED)
        n, bounds = len(self.words.hashes), self.words.bounds
        self.text = np.repeat(np.arange(len(self.texts)), np.diff(bounds))
        place = np.arange(n) - bounds[self.text]
        fits = np.arange(n) + ANCHOR <= bounds[self.text + 1]
        self.anchors = np.flatnonzero(np.isin(place % PERIOD, COVER) & fits)
        self.anchor_values, self.anchor_index, self.anchor_counts = np.unique(
            windows(self.words.hashes, ANCHOR)[self.anchors], return_inverse=True, return_counts=True
        )

    def extend(self, repeated: np.ndarray) -> None:
        """Full windows that hold an anchor which is repeated, here or (by `repeated`) elsewhere."""
        repeated = (repeated | (self.anchor_counts > 1))[self.anchor_index]
        n, bounds = len(self.words.hashes), self.words.bounds
        steps = np.zeros(n + 1, np.int64)
        at = self.anchors[repeated]
        np.add.at(steps, np.maximum(at - (PERIOD - 1), bounds[self.text[at]]), 1)
        np.add.at(steps, at + 1, -1)
        self.starts = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & (np.arange(n) + SPAN <= bounds[self.text + 1]))
        self.values, self.first, self.index = np.unique(
            windows(self.words.hashes, SPAN)[self.starts], return_index=True, return_inverse=True
        )

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Mask of the words in windows that begin earlier too, here or (by `earlier`) elsewhere."""
        later = earlier[self.index] | (self.first[self.index] != np.arange(len(self.index)))
        steps = np.zeros(len(self.words.hashes) + 1, np.int64)
        np.add.at(steps, self.starts[later], 1)
        np.add.at(steps, self.starts[later] + SPAN, -1)
        return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each word of a window that begins earlier too; one row per document.

    Words are runs without ASCII white space, unchanged. A window's earlier occurrence is in a document with a smaller id,
    or begins before it in the same document; windows are judged on the input, not on what is left.

    Columns: doc_id, row_key (hash of doc_id and text), n_words, n_removed, kept (the other words, joined by a blank).

    A null or empty text has no words and keeps the empty text. A null doc_id is smaller than all others; rows that share a
    doc_id, also repeated ones, count as following each other in the order in which they were read. A document shorter
    than a window loses nothing. An empty table gives no rows. Other columns are not read.
    """
    blocks = blocks_of(docs.select(doc_id, text), doc_id, text)
    n_buckets = n_buckets_for(blocks, len(COVER) / PERIOD / WORD_BYTES)
    blocks = blocks.drop("n_bytes", "rest")

    def send_anchors(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            block = _Block(row)
            for bucket, part in slices(block.anchor_values, n_buckets):
                yield bucket, row[0], block.anchor_values[part].tobytes()

    anchors = map_rows(blocks, send_anchors, "bucket int, block bigint, hashes binary")
    repeated = exchange(anchors, twice, "repeated")

    def send_windows(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            block = _Block(row)
            block.extend(bits(row[4], block.anchor_values, n_buckets))
            docs_of = block.order[block.text[block.starts[block.first]]]
            for bucket, part in slices(block.values, n_buckets):
                yield bucket, row[0], block.values[part].tobytes(), docs_of[part].tobytes()

    marked = lookup_join(blocks, repeated, "block", "left", hot=False)
    sent = map_rows(marked, send_windows, "bucket int, block bigint, hashes binary, docs binary")
    earlier = exchange(sent, not_first, "earlier")

    def finish(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            block = _Block(row)
            block.extend(bits(row[4], block.anchor_values, n_buckets))
            removed = block.removed(bits(row[5], block.values, n_buckets))
            found = block.words
            for t, (key, row_key) in enumerate(zip(block.doc_ids, block.row_keys, strict=True)):
                own, gone = found.of(t), removed[found.of(t)]
                starts, ends = found.starts[own][~gone].tolist(), found.ends[own][~gone].tolist()
                kept = b" ".join([found.joined[a:b] for a, b in zip(starts, ends, strict=True)])
                yield key, row_key, len(gone), int(gone.sum()), kept.decode()

    marked = lookup_join(marked, earlier, "block", "left", hot=False)
    return map_rows(
        marked, finish,
        "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept string",
    )

