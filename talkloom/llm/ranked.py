"""Ranked lexical search by blocked dense matrix products.

Items and documents are bags of terms. A document's term has an impact, a whole number below a million that grows with the
term's occurrences and falls with the document's length; an item's term has its weight times its repeats. Scores of a tile of
items against a tile of documents are one matrix product over the terms that both tiles hold. Products are float64, and
exact, since the terms are dealt to products whose sums stay below 2^53; those sums are added as 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.segments import segments
from talkloom.llm.tables import map_rows, utf8
from talkloom.runtime import cut, lookup_join, top_n_per_group

# Items, documents and terms of a tile: 8 MB of items, 16 MB of documents.
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 256, 512, 4096
# Items are searched in passes over the documents of so many bytes of text each; the driver holds one pass's items.
PASS_BYTES = 4 << 20
# Sums of products below this are exact in float64; impacts are at most IMPACT.
EXACT, IMPACT = 1 << 53, 1_000_000
# Order of a null doc_id: before all others.
FIRST = np.iinfo(np.int64).min

# Terms are runs of ASCII letters and digits and of all that is not ASCII; A-Z count as a-z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_BLANK = re.compile(b" ")


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text, a segment at a time."""
    for part in segments((text or b"").translate(_TERMS), _BLANK):
        yield part.split()


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def length_factor(n_terms: int, n_docs: int, total: int) -> int:
    return 25 + 75 * n_terms * n_docs // total


class Items:
    """Items of a pass as term counts over their vocabulary, in tiles of items."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        counts = [(number, Counter(t for part in terms_of(text) for t in part)) for number, text in rows]
        counts = [(number, c) for number, c in counts if c]
        self.numbers = [number for number, _ in counts]
        self.terms = sorted(set().union(*(c for _, c in counts)))
        column = {t: i for i, t in enumerate(self.terms)}
        self.rows = [
            (np.array([column[t] for t in c], np.int32), np.array(list(c.values()), np.int64)) for _, c in counts
        ]

    def tiles(self, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First item, terms (sorted columns) and matrix of weights times repeats, items by terms, of each tile."""
        for at in range(0, len(self.rows), TILE_ITEMS):
            part = self.rows[at : at + TILE_ITEMS]
            columns = np.unique(np.concatenate([c for c, _ in part]))
            matrix = np.zeros((len(part), len(columns)), np.int64)
            for row, (c, n) in enumerate(part):
                matrix[row, np.searchsorted(columns, c)] = weights[c] * n
            yield at, columns, matrix


def product(items: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Exact product of two matrices of whole numbers, the second's at most IMPACT."""
    n = items.shape[1]
    if n > TILE_TERMS or (n > 1 and n and items.sum(axis=1).max(initial=0) * IMPACT >= EXACT):
        return product(items[:, : n // 2], impacts[: n // 2]) + product(items[:, n // 2 :], impacts[n // 2 :])
    if items.max(initial=0) * IMPACT >= EXACT:  # an item that repeats a single term some hundred thousand times
        return items @ impacts
    return (items.astype(np.float64) @ impacts.astype(np.float64)).astype(np.int64)


class Best:
    """The best `k` documents of each item of a tile so far: those that tie with the last are looked at again."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        score = np.concatenate([self.score, scores[item, at]])
        item, doc = np.concatenate([self.item, item]), np.concatenate([self.doc, docs[at]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def _postings(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """Per document with terms: doc_id, n_terms, and its terms of the vocabulary with their counts."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        column = {t: i for i, t in enumerate(terms)}.get
        for key, data in rows:
            n, found = 0, []
            for words in terms_of(data):
                n += len(words)
                codes = np.fromiter(map(column, words, repeat(-1)), np.int32, len(words))
                found.append(codes[codes >= 0])
            if n:
                columns, counts = np.unique(np.concatenate(found), return_counts=True)
                yield key, n, columns.astype("<i4").tobytes(), counts.astype("<i8").tobytes()

    known = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    return cut(map_rows(known, run, "doc_id bigint, n_terms bigint, columns binary, counts binary"), "postings")


def _frequencies(postings: DataFrame, n: int) -> np.ndarray:
    """Documents that hold each term; a row per term reaches the driver."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        total = np.zeros(n, np.int64)
        for (columns,) in rows:
            total[np.frombuffer(columns, "<i4")] += 1
        yield from ((int(i), int(total[i])) for i in np.flatnonzero(total))

    counted = map_rows(postings.select("columns"), run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    result = np.zeros(n, np.int64)
    for row in counted.collect():
        result[row["term"]] = row["n"]
    return result


def _search(postings: DataFrame, items: Items, weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """The best documents of each item in each partition: item, doc_id, score."""

    def blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == TILE_DOCS:
                yield held
                held = []
        if held:
            yield held

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        tiles = list(items.tiles(weights))
        best = [Best(len(matrix), k) for _, _, matrix in tiles]
        for held in blocks(rows):
            ids = np.array([FIRST if r[0] is None else r[0] for r in held], np.int64)
            columns = [np.frombuffer(r[2], "<i4") for r in held]
            sizes = [len(c) for c in columns]
            column, tf = np.concatenate(columns), np.concatenate([np.frombuffer(r[3], "<i8") for r in held])
            factor = np.array([length_factor(r[1], n_docs, total) for r in held], np.int64)
            doc = np.repeat(np.arange(len(held)), sizes)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * factor[doc])
            present, place = np.unique(column, return_inverse=True)
            for (_, terms, matrix), top in zip(tiles, best, strict=True):
                both = np.isin(present, terms, assume_unique=True)
                row = np.cumsum(both) - 1
                kept = both[place]
                dense = np.zeros((int(both.sum()), len(held)), np.int64)
                dense[row[place[kept]], doc[kept]] = impact[kept]
                top.add(product(matrix[:, np.searchsorted(terms, present[both])], dense), ids)
        for (first, _, _), top in zip(tiles, best, strict=True):
            for item, key, score in zip(top.item.tolist(), top.doc.tolist(), top.score.tolist(), strict=True):
                yield items.numbers[first + item], None if key == FIRST else key, score

    return map_rows(postings, run, "_item bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The `k` highest-scoring documents of each item, of those with a score above 0: item_id, rank, doc_id, score.

    Equal scores rank by ascending doc_id, a null doc_id first. Rows that share a doc_id, also repeated ones, are documents
    of their own; so are items that share an item_id, each with ranks from 1. Null, empty and term-less texts match nothing
    and count for nothing. Empty tables give no rows. Other columns are not read. A task holds the items of a pass, an
    item's vocabulary among them, and one text in segments of a megabyte; an item's text should be far below a gigabyte.
    """
    known = cut(
        items.select(
            items[item_id].alias("item_id"), utf8(text).alias("text"), F.monotonically_increasing_id().alias("_item")
        ),
        "items",
    )
    n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-n_bytes // pass_bytes))
    found = []
    for number in range(passes):
        part = known.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == number).select("_item", "text")
        held = Items(sorted((r["_item"], r["text"]) for r in part.collect()))
        postings = _postings(docs, held.terms, doc_id, text)
        n_docs, total = postings.agg(F.count("*"), F.sum("n_terms")).first()
        if not n_docs or not held.rows:
            continue
        weights = np.array([weight(n_docs, int(f)) for f in _frequencies(postings, len(held.terms))], np.int64)
        scored = _search(postings, held, weights, n_docs, total, k)
        found.append(cut(top_n_per_group(scored, ["_item"], [F.desc("score"), F.col("doc_id")], k), "ranked"))
    schema = f"item_id {known.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    ranked = found[0]
    for other in found[1:]:
        ranked = ranked.unionByName(other)
    named = lookup_join(ranked, known.select("_item", "item_id"), "_item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
