"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts the suffixes of its documents, a shard of about a megabyte at a time, and binary-searches every
suffix of the benchmark items in it. No document is moved. The items are read in parts of a bounded size, one pass over
the texts each, so that neither the driver nor a task ever holds more than one part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.tables import keyed, map_rows
from talkloom.llm.words import ALPHANUMERIC, chunks, words
from talkloom.runtime import cut

WINDOW = 13
# A document with hits is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
SHARD_BYTES = 1 << 20
# Text of the items that are searched in one pass.
ITEM_BYTES = 16 << 20

_STATE = "n_words bigint, hits binary, n_hit bigint, items array<string>, unnamed boolean, longest bigint, longest_item string, longest_at bigint"


class SuffixArray:
    """Suffixes of word sequences in the order of their first `depth` words' hashes."""

    def __init__(self, sequences: list[np.ndarray], depth: int):
        """Sequences are kept apart by zeros; no word has the hash zero."""
        gap = np.zeros(1, np.uint64)
        self.text = np.concatenate([x for s in sequences for x in (s, gap)] + [np.zeros(depth, np.uint64)])
        self.starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in sequences])))  # of each sequence
        self.depth = depth
        n = int(self.starts[-1])
        order = np.argsort(self.text[:n], kind="stable")
        rank = np.empty(len(self.text), np.int64)
        rank[n:] = -1
        rank[order] = self._heads(self.text[order])
        length = 1
        while length < depth:
            tied = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[order]] > 1)  # places whose order is open
            if not len(tied):
                break
            suffixes = order[tied]
            following = rank[np.minimum(suffixes + length, len(self.text) - 1)]
            key = rank[suffixes] * (n + 2) + following + 1
            by = np.argsort(key, kind="stable")
            order[tied] = suffixes[by]
            heads = self._heads(key[by], tied)
            rank[suffixes[by]] = heads
            length *= 2
        self.order = order

    @staticmethod
    def _heads(keys: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """For sorted keys, the place of the first equal one."""
        places = np.arange(len(keys)) if places is None else places
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]

    def _bound(self, patterns: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """First place whose suffix isn't before the pattern (or, with `after`, is behind all that begin with it)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.order))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = self.order[np.minimum(middle, len(self.order) - 1)]
            less, equal = np.zeros(len(patterns), bool), np.ones(len(patterns), bool)
            for j in range(patterns.shape[1]):
                compared = equal & (j < lengths)
                if not compared.any():
                    break
                word = self.text[at + j]
                less |= compared & (word < patterns[:, j])
                equal &= ~compared | (word == patterns[:, j])
            before = less | equal if after else less
            low = np.where(open_ & before, middle + 1, low)
            high = np.where(open_ & ~before, middle, high)
        return low

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: which pattern, and at which place of `text`. No pattern is longer than `depth`."""
        if not len(patterns) or not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self._bound(patterns, lengths, after=False)
        at = self.order[np.minimum(low, len(self.order) - 1)]
        same = (self.text[at[:, None] + np.arange(patterns.shape[1])] == patterns) | (
            np.arange(patterns.shape[1]) >= lengths[:, None]
        )
        found = np.flatnonzero((low < len(self.order)) & same.all(axis=1))
        low = low[found]
        counts = self._bound(patterns[found], lengths[found], after=True) - low
        which = np.repeat(found, counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, self.order[np.repeat(low, counts) + within]


@dataclass
class Items:
    """The different windows of a part of the items, and where each occurs in them."""

    names: list[str | None]  # sorted, null last
    patterns: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # occurrences of window w are first[w] to first[w + 1]
    item: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes | None]], window: int) -> Items:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
        found = words([text for _, text in rows], ALPHANUMERIC, lower=True)
        parts = [], [], [], []
        for i in range(len(rows)):
            own = found.hashes[found.of(i)]
            size = min(window, len(own))
            if size:
                at = np.arange(len(own) - size + 1)
                padded = np.zeros((len(at), window), np.uint64)
                padded[:, :size] = own[at[:, None] + np.arange(size)]
                for part, x in zip(parts, (padded, np.full(len(at), size), np.full(len(at), i), at), strict=True):
                    part.append(x)
        if not parts[0]:
            empty = np.zeros(0, np.int64)
            return cls([], np.zeros((0, window), np.uint64), empty, np.zeros(1, np.int64), empty, empty)
        patterns, lengths, item, offset = (np.concatenate(p) for p in parts)
        different, inverse = np.unique(patterns, axis=0, return_inverse=True)  # zeros fill up: no two lengths are equal
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        first = np.searchsorted(inverse[by], np.arange(len(different) + 1))
        return cls([r[0] for r in rows], different, lengths[by][first[:-1]], first, item[by], offset[by])


def _search(texts: list[bytes | None], items: Items) -> list[tuple]:
    """Of each text: words, bits of the words that are hit, items, and the longest verbatim match with its place."""
    found = words(texts, ALPHANUMERIC, lower=True)
    array = SuffixArray([found.hashes[found.of(t)] for t in range(len(texts))], items.patterns.shape[1])
    pattern, at = array.find(items.patterns, items.lengths)
    text = np.searchsorted(array.starts, at, side="right") - 1
    steps = np.zeros(len(array.text) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + items.lengths[pattern], -1)
    hit = np.cumsum(steps) > 0
    # Each occurrence once for every place of its window in the items.
    times = np.diff(items.first)[pattern]
    source = np.repeat(items.first[pattern], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, at, size = items.item[source], np.repeat(at, times), np.repeat(items.lengths[pattern], times)
    text, diagonal = np.repeat(text, times), at - items.offset[source]
    order = np.lexsort((at, diagonal, item, text))
    item, at, size, text, diagonal = (x[order] for x in (item, at, size, text, diagonal))
    run = np.ones(len(at), bool)
    run[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(run)
    lasts = np.append(begins[1:], len(at)) - 1 if len(at) else begins
    spans = at[lasts] + size[lasts] - at[begins] if len(at) else begins
    bounds, inside = np.searchsorted(text[begins], np.arange(len(texts) + 1)), []
    for t in range(len(texts)):
        own = slice(array.starts[t], array.starts[t + 1] - 1)
        n, mine = own.stop - own.start, slice(bounds[t], bounds[t + 1])
        longest = None
        if mine.start < mine.stop:
            best = mine.start + int(spans[mine].argmax())
            longest = (int(spans[best]), items.names[item[begins[best]]], int(at[begins[best]] - own.start))
        names = {items.names[i] for i in np.unique(item[begins[mine]])}
        inside.append((n, np.packbits(hit[own]).tobytes(), int(hit[own].sum()), sorted(names - {None}), None in names, *(longest or (0, None, None))))
    return inside


def _merged(old: tuple | None, new: tuple) -> tuple:
    if old is None:
        return new
    hits = np.frombuffer(old[1], np.uint8) | np.frombuffer(new[1], np.uint8)
    n_hit = int(np.unpackbits(hits).sum())  # bits behind the last word are 0
    return new[0], hits.tobytes(), n_hit, sorted({*old[3], *new[3]}), old[4] or new[4], *max(old[5:], new[5:], key=lambda x: x[0])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """Verbatim matches of benchmark items in the documents, one row per document.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. A window is `window` consecutive words
    of an item, or the whole of a shorter one; a document's words inside any occurrence of a window are hit.

    Columns: doc_id, row_key (hash of doc_id and text), n_words, n_hit, items (ids of the items with occurring windows, as
    different, sorted strings), unnamed (an item of null id occurs), longest (words of the longest verbatim match), longest_item, longest_at (its first word),
    contaminated (some words are hit, and at least one in 20). Of equally long matches the first item's first counts.

    A null or empty text, or one without words, has no words and isn't contaminated. Items that are null, empty or without
    words match nothing; one whose id is null hits words like others, without a name; rows that share an item_id are items of one name. Repeated documents give
    repeated rows; empty tables give no rows, or rows without hits. Other columns are not read.
    """
    wanted = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("binary").alias("text")
    )
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = -(-size // item_bytes) or 1
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    state = keyed(docs, doc_id, text)
    for part in range(n_parts):
        rows = wanted.where(part_of == part).collect()  # item_bytes of text
        items = Items.of([(r.item_id, None if r.text is None else bytes(r.text)) for r in rows], window)
        state = map_rows(
            state, _pass(items, first=part == 0, last=part == n_parts - 1),
            f"doc_id bigint, text binary, row_key bigint, {_STATE}",
        )
        if part < n_parts - 1:
            state = cut(state, "benchmark-pass")  # this part is searched before the next one is read
            del rows, items
    enough = (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return state.drop("text", "hits").withColumn("contaminated", enough)


def _pass(items: Items, first: bool, last: bool):
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for shard in chunks(rows, text=1, limit=SHARD_BYTES):
            for row, found in zip(shard, _search([r[1] for r in shard], items), strict=True):
                yield row[0], None if last else row[1], row[2], *_merged(None if first else row[3:], found)

    return run
