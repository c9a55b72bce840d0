"""Line dedup over deletion neighbourhoods: lines that equal an earlier one, or are one edit away from it, go.

Copies are found first, by the hashes of all lines that are not blank. For the first lines of their kind, if they are long
enough, a coarse neighbourhood is compared: the line without one of its PARTS parts, for the line's own length and for one character less. Only lines that share such a key
can be one edit apart; of these, the same is asked for FINE parts. A line then emits its neighbourhood, the strings with one
character deleted, for the places in the parts without which it equals another line. Two lines are one edit apart if they
lack the same place and are equal without it, or if one is the other without a character; so each is compared with the
earliest of its key, not with all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkloom.llm.exchange import bits, blocks_of, exchange, n_buckets_for, not_first, order_of, slices, twice
from talkloom.llm.tables import map_rows
from talkloom.llm.words import Sums, followed, hashed, mix
from talkloom.runtime import cut, lookup_join

# Shorter lines go only as copies: of a few characters, many differ in one.
LEAST_CHARS = 16
PARTS, FINE = 4, 32
# Characters of blank lines.
_BLANK = " \t\v\f\r"
# Characters of a usual line, for the number of buckets only.
LINE_CHARS = 100

# What a line does in the group of a key: it lacks the same place, it is longer by one character, it is the shorter one.
_SAME, _LONGER, _SHORTER = 0, 1, 2


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """A random number for each code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


class _Lines:
    """Lines of a block's documents, in the order of doc_id and place, as running sums over code points."""

    def __init__(self, row: tuple):
        self.doc_ids, self.row_keys, self.texts = row[1], row[2], row[3]
        self.lines = [(t or b"").decode().split("\n") if t else [] for t in self.texts]
        self.text = np.repeat(np.arange(len(self.lines)), [len(x) for x in self.lines])
        self.flat = [line for lines in self.lines for line in lines]
        self.sizes = np.array([len(line) for line in self.flat], np.int64)
        points = np.frombuffer("".join(self.flat).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sums = Sums(_characters()[points])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.compared = np.flatnonzero(np.array([bool(line.strip(_BLANK)) for line in self.flat], bool))
        own = self.compared
        self.values, self.first, self.index = np.unique(
            hashed(self.sums.of(self.starts[own], self.ends[own]), self.sizes[own]), return_index=True, return_inverse=True
        )
        self.docs = order_of(self.doc_ids)[self.text]

    def firsts(self, later: np.ndarray, least_chars: int = 0) -> np.ndarray:
        """Lines without an earlier copy, `later` being the values that have one in another block."""
        lines = self.compared[self.first[~later]]
        return lines[self.sizes[lines] >= least_chars]

    def copies(self, later: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(self.flat), bool)
        mask[self.compared] = True
        mask[self.firsts(later)] = False
        return mask

    def coarse(self, lines: np.ndarray, parts: int = PARTS) -> np.ndarray:
        """Keys of each line, a row per line: for its own length and for one less, without each part. A line of one
        character more lacks that character in one part, which is then longer."""
        columns = []
        size, start, end = self.sizes[lines], self.starts[lines], self.ends[lines]
        for shorter in (0, 1):
            n = size - shorter
            for part in range(parts):
                low, high = part * n // parts, (part + 1) * n // parts
                before = hashed(self.sums.of(start, start + low), n)
                behind = hashed(self.sums.of(start + high + shorter, end), part)
                key = before * np.uint64(3) + behind
                columns.append(mix(key))
        return np.stack(columns, axis=1)

    def neighbourhood(self, line: int, columns: list[int], parts: int) -> Iterator[tuple[int, int]]:
        """Keys and roles of a line: itself as the shorter one, and the strings without one character of the parts whose
        `columns` of `coarse` it shares."""
        start, end, n = self.starts[line], self.ends[line], int(self.sizes[line])
        for shorter in (0, 1):
            ranges = [
                np.arange(c % parts * (n - shorter) // parts, (c % parts + 1) * (n - shorter) // parts + shorter)
                for c in columns if c // parts == shorter
            ]
            if not ranges:
                continue
            at = start + np.unique(np.concatenate(ranges))
            before = self.sums.of(np.full(len(at), start), at)
            rest = followed(before, self.sums.of(at + 1, np.full(len(at), end)), at - start)
            if shorter:
                keys, role = np.unique(hashed(rest, n - 1)), _LONGER
            else:
                whole = self.sums.of(np.array([start]), np.array([end]))
                yield int(hashed(whole, n).view(np.int64)[0]), _SHORTER
                keys, role = mix(hashed(rest, n) + (at - start).astype(np.uint64)), _SAME
            yield from ((key, role) for key in keys.view(np.int64).tolist())


def _close_lines(held: _Lines, copy_bits, close_bits, n_buckets: int, least_chars: int) -> np.ndarray:
    """First lines of their kind that share a coarse key with another one."""
    lines = held.firsts(bits(copy_bits, held.values, n_buckets), least_chars)
    keys = held.coarse(lines)
    values, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    close = bits(close_bits, values, n_buckets) | (counts > 1)
    return lines[close[index.reshape(keys.shape)].any(axis=1)]


def remove_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS
) -> DataFrame:
    """Remove each line that an earlier one equals, or differs from by one inserted, deleted or replaced character.

    Lines end at line feeds. Earlier is a line of a smaller doc_id, or a line before it in the same document; lines are
    judged on the input, so a line also goes if the earlier one went itself. A line of fewer than `least_chars` characters
    (at least one) goes only if an earlier one equals it; blank lines, of ASCII white space or nothing, all stay.

    Columns: doc_id, row_key (hash of doc_id and text), n_lines, n_compared (lines that are not blank), n_removed, kept
    (the other lines, joined by line feeds), rest (the other columns of `docs` as a struct; null if there are none).

    A null or empty text has no lines and keeps the empty text. A null doc_id is smaller than all others; rows that share a
    doc_id, also repeated ones, count as following each other in the order in which they were read. An empty table gives
    no rows.
    """
    if least_chars < 1:
        raise ValueError("least_chars: at least one")
    blocks = blocks_of(docs, doc_id, text)
    n_buckets = n_buckets_for(blocks, 2 * PARTS / LINE_CHARS)
    read = ["block", "doc_ids", "row_keys", "texts"]

    def send_lines(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            held = _Lines(row)
            docs_of = held.docs[held.compared[held.first]]
            for bucket, part in slices(held.values, n_buckets):
                yield bucket, row[0], held.values[part].tobytes(), docs_of[part].tobytes()

    sent = map_rows(blocks.select(read), send_lines, "bucket int, block bigint, hashes binary, docs binary")
    marked = lookup_join(blocks, exchange(sent, not_first, "copies"), "block", "left", hot=False)

    def send_keys(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            held = _Lines(row)
            keys = np.unique(held.coarse(held.firsts(bits(row[4], held.values, n_buckets), least_chars)))
            for bucket, part in slices(keys, n_buckets):
                yield bucket, row[0], keys[part].tobytes()

    sent = map_rows(marked.select(*read, "copies"), send_keys, "bucket int, block bigint, hashes binary")
    marked = lookup_join(marked, exchange(sent, twice, "close"), "block", "left", hot=False)

    def send_close(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            held = _Lines(row)
            for line in _close_lines(held, row[4], row[5], n_buckets, least_chars).tolist():
                yield int(held.docs[line]), row[0], line, held.flat[line]

    close = map_rows(
        marked.select(*read, "copies", "close"), send_close, "doc bigint, block bigint, line int, string string"
    )
    close = cut(close, "close-lines")
    near = _near(close).groupBy("block").agg(F.collect_list("line").alias("near"))
    marked = lookup_join(marked.drop("close"), cut(near, "near-lines"), "block", "left", hot=False)

    def finish(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            held = _Lines(row)
            gone = held.copies(bits(row[4], held.values, n_buckets))
            gone[row[5] or []] = True
            compared = np.zeros(len(held.flat), bool)
            compared[held.compared] = True
            at = 0
            for key, row_key, lines, rest in zip(held.doc_ids, held.row_keys, held.lines, row[6], strict=True):
                own = slice(at, at + len(lines))
                kept = "\n".join(line for line, out in zip(lines, gone[own].tolist(), strict=True) if not out)
                yield key, row_key, len(lines), int(compared[own].sum()), int(gone[own].sum()), kept, rest
                at = own.stop

    schema = StructType.fromDDL(
        "doc_id bigint, row_key bigint, n_lines bigint, n_compared bigint, n_removed bigint, kept string"
    ).add("rest", blocks.schema["rest"].dataType.elementType)
    return map_rows(marked.select(*read, "copies", "near", "rest"), finish, schema)


def _near(close: DataFrame) -> DataFrame:
    """block and line of the lines with an earlier one an edit away; the lines differ from each other."""

    def held_of(strings: Iterable[str]) -> _Lines:
        return _Lines((0, [None], [0], ["\n".join(strings).encode()]))

    def fine(rows: Iterable[tuple]) -> Iterator[tuple]:
        for some in batched(rows, 256):
            keys = held_of(r[2] for r in some).coarse(np.arange(len(some)), FINE).view(np.int64).tolist()
            for (block, line, _), own in zip(some, keys, strict=True):
                yield from ((key, column, block, line) for column, key in enumerate(own))

    def expand(rows: Iterable[tuple]) -> Iterator[tuple]:
        for some in batched(rows, 256):
            held = held_of(r[3] for r in some)
            for n, (doc, block, line, _, columns) in enumerate(some):
                yield from ((key, role, doc, block, line) for key, role in held.neighbourhood(n, columns, FINE))

    parts = map_rows(close.select("block", "line", "string"), fine, "key bigint, part int, block bigint, line int")
    parts = cut(parts, "line-parts")
    shared = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # Lines of one template share a key: their rows are spread over salts.
    shared = lookup_join(parts, cut(shared, "line-shared"), "key").groupBy("block", "line").agg(F.collect_set("part").alias("parts"))
    narrow = close.join(shared, ["block", "line"]).select("doc", "block", "line", "string", "parts")
    keys = map_rows(narrow, expand, "key bigint, role int, doc bigint, block bigint, line int")
    place = F.struct("doc", "block", "line")
    least = [F.min(F.when(F.col("role") == role, place)).alias(f"least{role}") for role in (_SAME, _LONGER, _SHORTER)]
    keys = cut(keys, "line-keys")
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), *least).where("n > 1").drop("n")
    groups = cut(groups, "line-groups")
    # Each line's rivals: the earliest with the same gap, the shorter one, or the earliest longer one.
    rival = F.when(F.col("role") == _SAME, F.col(f"least{_SAME}")).when(
        F.col("role") == _LONGER, F.col(f"least{_SHORTER}")
    ).otherwise(F.col(f"least{_LONGER}"))
    pairs = lookup_join(keys, groups, "key").select("doc", "block", "line", rival.alias("rival"))
    pairs = pairs.where(F.col("rival") < place).select("block", "line", "rival.block", "rival.line").toDF(
        "block", "line", "other_block", "other_line"
    ).distinct()
    other = close.select(
        F.col("block").alias("other_block"), F.col("line").alias("other_line"), F.col("string").alias("other")
    )
    pairs = pairs.join(close.select("block", "line", "string"), ["block", "line"]).join(other, ["other_block", "other_line"])
    return pairs.where(F.levenshtein("string", "other", 1).between(0, 1)).select("block", "line").distinct()
