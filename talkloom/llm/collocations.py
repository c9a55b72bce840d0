"""Frequent phrases and their cohesion, by set-oriented mining over sorted occurrence relations.

A relation holds the occurrences of all phrases of one length, in the order of their pieces and places. Its merge-join with
itself at the next place gives the phrases that are one word longer; they are counted by group over all relations, and
occurrences of groups below the least count leave before the next join. Words and phrases are counted per language.

The relations lie in blocks of about half a million words: an array of places, holding a block's own number of the phrase that
begins there, or -1. Blocks send each of their different phrases once, with its count, to a bucket, which adds the counts
and gives frequent phrases an id. A phrase is the pair of the ids of the two phrases that it was joined from, so nothing is
decided by a hash alone.

Numbers are kept and sent as compressed planes of bytes (`_pack`): most have zeros in their high bytes.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.exchange import BUCKET_BYTES, slices
from talkloom.llm.segments import segments
from talkloom.llm.tables import map_rows, utf8
from talkloom.llm.words import mix
from talkloom.runtime import cut, lookup_join, scratch_path, top_n_per_group

LONGEST, LEAST, TOP = 5, 100, 2000
BLOCK_WORDS = 1 << 19
UNKNOWN = "und"
# A block to a row group, since a reader holds one as a whole.
_FILES = {"parquet.block.row.count.limit": 1, "compression": "zstd"}

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(
    10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)  # ends of pieces as line feeds, tabs as blanks, A-Z as a-z
_BREAK = re.compile(b"[ \n]")

_WORDS = "block bigint, n bigint, places binary, hashes binary, counts binary, words binary, totals array<struct<lang:string,n:bigint>>"
_PHRASES = "block bigint, n bigint, places binary, prefixes binary, suffixes binary, counts binary"
_MARKS = "bucket int, block bigint, bits binary, ranks binary, words binary, prefixes binary, suffixes binary, counts binary"
# Behind a language in the bytes that stand for one of its words, and between words; UTF-8 has no such bytes.
_OF, _NEXT = b"\xff", b"\xfe"


def _pack(values: np.ndarray) -> bytes:
    """The numbers' first bytes, second bytes and so on, compressed, behind the length of all."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size // width).T).reshape(-1).view(kind)


class _Block:
    """Words of a block while it is read: a number per place, -1 between pieces."""

    def __init__(self):
        self.places = array("i")
        number = itertools.count()
        self.words: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))

    def end_piece(self) -> None:
        if self.places and self.places[-1] >= 0:
            self.places.append(-1)

    def row(self, block: int) -> tuple:
        """The block with its words in the order of their hashes."""
        places = np.frombuffer(self.places, np.int32)
        named = [(code, lang.encode() + _OF + word) for lang, known in self.words.items() for word, code in known.items()]
        codes = np.array([code for code, _ in named])
        hashes = np.array([xxhash.xxh3_64_intdigest(word) for _, word in named], np.uint64)
        counts = np.bincount(places[places >= 0], minlength=len(named))
        order = np.argsort(hashes, kind="stable")
        rank = np.full(len(named) + 1, -1, np.int32)
        rank[codes[order]] = np.arange(len(named), dtype=np.int32)
        totals = [{"lang": lang, "n": int(counts[list(known.values())].sum())} for lang, known in self.words.items() if known]
        return (
            block, len(named), _pack(rank[places].astype("<i4")), hashes[order].astype("<u8").tobytes(),
            _pack(counts[codes[order]].astype("<i4")), _NEXT.join([named[i][1] for i in order]), totals,
        )


def _read_words(rows: Iterable[tuple], block_words: int) -> Iterator[tuple]:
    number, block = TaskContext.get().partitionId() << 33, _Block()
    for lang, text in rows:
        for part in segments((text or b"").translate(_TABLE), _BREAK):
            for at, piece in enumerate(part.split(b"\n")):
                if at:
                    block.end_piece()
                    if len(block.places) >= block_words:
                        yield block.row(number)
                        number, block = number + 1, _Block()
                block.places.extend(map(block.words[lang].__getitem__, piece.split()))
        block.end_piece()
        if len(block.places) >= block_words:
            yield block.row(number)
            number, block = number + 1, _Block()
    if block.places:
        yield block.row(number)


def _key(prefixes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    return mix(prefixes.astype(np.uint64) + mix(suffixes.astype(np.uint64)))


def _join(places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge-join of a relation with itself at the next place, after what isn't frequent (id -1) has left it.

    Gives the places of the longer phrases, and of each different one the ids it was joined from and its count, in the
    order of their hashes.
    """
    kept = np.append(ids >= 0, False)[places]  # a place without a phrase is -1, the last
    at = np.flatnonzero(kept[:-1] & kept[1:])
    pair = places[at].astype(np.int64) * len(ids) + places[at + 1]
    pairs, code, counts = np.unique(pair, return_inverse=True, return_counts=True)
    prefixes, suffixes = ids[pairs // max(len(ids), 1)], ids[pairs % max(len(ids), 1)]
    order = np.argsort(_key(prefixes, suffixes), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    longer = np.full(len(places), -1, np.int32)
    longer[at] = rank[code]
    return longer, prefixes[order], suffixes[order], counts[order]


def _joined(block: int, places: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    longer, prefixes, suffixes, counts = _join(places, ids)
    if len(counts):
        yield block, len(counts), *(_pack(x) for x in (longer, prefixes, suffixes, counts.astype("<i4")))


def _words(group: pd.DataFrame) -> list[bytes]:
    return list(itertools.chain.from_iterable(w.split(_NEXT) for w in group["words"]))


def _groups(group: pd.DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each phrase (or word) that the blocks sent to a bucket, and a phrase of each group."""
    if kind == "word":
        number, _ = pd.factorize(np.array([*_words(group), None], object)[:-1])
        return number, np.unique(number, return_index=True)[1]
    prefixes, suffixes = (np.concatenate([np.frombuffer(x, kind) for x in group[c]]) for c in ("prefixes", "suffixes"))
    order = np.lexsort((suffixes, prefixes))
    new = np.ones(len(order), bool)
    new[1:] = (prefixes[order[1:]] != prefixes[order[:-1]]) | (suffixes[order[1:]] != suffixes[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _judge(group: pd.DataFrame, least: int, kind: str) -> Iterator[tuple]:
    """Adds the counts that the blocks sent to a bucket: the frequent phrases' ranks in the bucket for each block, and the
    phrases themselves in the order of their ranks."""
    bucket, counts = int(group["bucket"].iloc[0]), np.concatenate([np.frombuffer(x, "<i4") for x in group["counts"]])
    number, first = _groups(group, kind)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, number, counts)
    frequent = total >= least
    ranks = np.where(frequent, np.cumsum(frequent) - 1, -1)[number].astype("<i4")
    end = 0
    for block, sent in zip(group["block"], group["counts"], strict=True):
        start, end = end, end + len(sent) // 4
        own = ranks[start:end]
        if (own >= 0).any():
            yield bucket, block, np.packbits(own >= 0).tobytes(), own[own >= 0].tobytes(), None, None, None, None
    at, packed = first[frequent], (None, None, None)
    if kind == "word":
        words = _words(group)
        packed = _NEXT.join([words[i] for i in at]), None, None
    else:
        packed = None, *(np.concatenate([np.frombuffer(x, kind) for x in group[c]])[at].tobytes() for c in ("prefixes", "suffixes"))
    yield bucket, None, None, None, *packed, total[frequent].astype("<i8").tobytes()


def _ids(keys: np.ndarray, marks: list[dict] | None, offsets: np.ndarray, kind: str) -> np.ndarray:
    """Ids of a block's phrases with these hashes, -1 where they aren't frequent."""
    ids, sent = np.full(len(keys), -1, kind), {m["bucket"]: m for m in marks or []}
    for bucket, part in slices(keys, len(offsets)):
        if bucket in sent:
            mask = np.unpackbits(np.frombuffer(sent[bucket]["bits"], np.uint8))[: part.stop - part.start].astype(bool)
            ids[part][mask] = offsets[bucket] + np.frombuffer(sent[bucket]["ranks"], "<i4")
    return ids


@dataclass
class _Counted:
    """Frequent phrases of one length as their buckets found them."""

    rows: DataFrame  # of _MARKS
    offsets: np.ndarray  # id of the first phrase of each bucket
    kind: str  # of ids: four bytes while those do
    sides: str  # of the ids that the phrases were joined from

    @property
    def marks(self) -> DataFrame:
        sent = self.rows.where("block IS NOT NULL").groupBy("block")
        return cut(sent.agg(F.collect_list(F.struct("bucket", "bits", "ranks")).alias("marks")), "marks")

    @property
    def phrases(self) -> DataFrame:
        """id, a (the count), the word with its language or else the ids of the phrases that were joined."""
        offsets, kind = self.offsets, self.sides

        def run(rows: Iterable[tuple]) -> Iterator[tuple]:
            for bucket, words, prefixes, suffixes, counts in rows:
                counts, at = np.frombuffer(counts, "<i8").tolist(), int(offsets[bucket])
                sides = [[None] * len(counts) if x is None else np.frombuffer(x, kind).tolist() for x in (prefixes, suffixes)]
                named = [None] * len(counts) if words is None else words.split(_NEXT)
                yield from zip(itertools.count(at), counts, named, *sides)

        packed = self.rows.where("block IS NULL").select("bucket", "words", "prefixes", "suffixes", "counts")
        return map_rows(packed, run, "id bigint, a bigint, word binary, prefix bigint, suffix bigint")


def _count(relation: DataFrame, least: int, kind: str) -> _Counted:
    """Frequent phrases of a relation; `kind` is that of the ids they were joined from, or `word`."""
    spark, is_word = relation.sparkSession, kind == "word"
    held = 4 + (8 if is_word else np.dtype(kind).itemsize)  # bytes of a phrase's count, and of its hash or prefix
    sent_bytes = 2 * held * (relation.agg(F.sum("n")).first()[0] or 0)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sent_bytes // BUCKET_BYTES + 1)

    def send(rows: Iterable[tuple]) -> Iterator[tuple]:
        for block, counts, *packed in rows:
            counts = _unpack(counts, "<i4")
            if is_word:
                words, keys = packed[0].split(_NEXT), np.frombuffer(packed[1], "<u8")
                for bucket, part in slices(keys, n_buckets):
                    yield bucket, block, _NEXT.join(words[part]), None, None, _pack(counts[part])
            else:
                prefixes, suffixes = (_unpack(x, kind) for x in packed)
                for bucket, part in slices(_key(prefixes, suffixes), n_buckets):
                    yield bucket, block, None, _pack(prefixes[part]), _pack(suffixes[part]), _pack(counts[part])

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        packed = {"counts": "<i4"} if is_word else {"counts": "<i4", "prefixes": kind, "suffixes": kind}
        group = group.assign(**{c: [_unpack(x, k).tobytes() for x in group[c]] for c, k in packed.items()})
        rows = [(*r[:3], r[3] and _pack(np.frombuffer(r[3], "<i4")), *r[4:]) for r in _judge(group, least, kind)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _MARKS.split(", ")])

    columns = ["words", "hashes"] if is_word else ["prefixes", "suffixes"]
    sent = map_rows(
        relation.select("block", "counts", *columns), send,
        "bucket int, block bigint, words binary, prefixes binary, suffixes binary, counts binary",
    )
    rows = cut(sent.groupBy("bucket").applyInPandas(judge, _MARKS), "phrase-counts")
    sizes = np.zeros(n_buckets + 1, np.int64)
    for r in rows.where("block IS NULL").select("bucket", (F.octet_length("counts") / 8).cast("int").alias("n")).collect():
        sizes[r["bucket"] + 1] = r["n"]
    ends = np.cumsum(sizes)
    return _Counted(rows, ends[:-1], "<i4" if ends[-1] < 1 << 31 else "<i8", "<i8" if is_word else kind)


def _first(words: DataFrame) -> DataFrame:
    """Frequent words as the shortest phrases."""
    of = F.expr("position(X'FF', word)")
    lang, word = F.expr("substring(word, 1, of - 1)").cast("string"), F.expr("substring(word, of + 1)").cast("string")
    none = F.array().cast("array<bigint>")
    return words.withColumn("of", of).select(
        "id", "a", lang.alias("lang"), word.alias("phrase"), word.alias("last"), none.alias("ls"), none.alias("rs")
    )


def _named(phrases: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with language, text, last word, and counts of their first parts `ls` and rests `rs`, by the cut."""
    sides = shorter.select("id", F.struct("lang", "phrase", "last", "a", "ls", "rs").alias("side"))
    for side in ("prefix", "suffix"):
        phrases = lookup_join(phrases, sides.select(F.col("id").alias(side), F.col("side").alias(f"_{side}")), side)
    return phrases.select(
        "id", "prefix", "suffix", "a", F.col("_prefix.lang").alias("lang"),
        F.concat_ws(" ", "_prefix.phrase", "_suffix.last").alias("phrase"), F.col("_suffix.last").alias("last"),
        F.array_append("_prefix.ls", F.col("_prefix.a")).alias("ls"),
        F.array_prepend("_suffix.rs", F.col("_suffix.a")).alias("rs"),
    )


def _lowest_cut() -> Column:
    """The cut of the lowest score, the shortest first part of several: a struct of score, cut, l, r. Exact while 1000 a n
    has at most 38 digits."""
    counted = F.transform(
        F.arrays_zip("ls", "rs"),
        lambda x, i: F.struct(
            F.call_function(
                "div",
                F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(17,0)"),
                x["ls"].cast("decimal(18,0)") * x["rs"].cast("decimal(18,0)"),
            ).alias("score"),
            i.alias("cut"), x["ls"].alias("l"), x["rs"].alias("r"),
        ),
    )
    return F.array_min(counted)


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The `top` phrases of two to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs without blanks and tabs within pieces that end at one of .,;:!? and at line ends; A-Z count as a-z. A
    phrase occurs `a` times, at least `least`; the cut of lowest score(1000 a n / (l r), rounded down) into a first part
    that occurs `l` times and a rest that occurs `r` times is the one that counts, the shortest first part of several. `n`
    counts the language's words. A phrase that occurs only within one longer phrase is left out. Order: score and `a`
    descending, then the phrase by its bytes.

    A null language is `und`; null, empty and word-less texts add nothing. Repeated rows are rows of their own, as ids are not
    read, nor are other columns. An empty table gives no rows. A long text is read in segments of a megabyte and dealt to
    several blocks; only a piece is kept in one, eight bytes a word.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"), utf8(text).alias("text"))

    def kept(rows: DataFrame, schema: str) -> DataFrame:
        path = scratch_path(spark, "occurrences")
        rows.write.options(**_FILES).parquet(path)
        return spark.read.schema(schema).parquet(path)

    relation = kept(map_rows(read, lambda rows: _read_words(rows, block_words), _WORDS), _WORDS)
    totals = relation.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    totals = cut(totals, "word-totals")
    counted = _count(relation, least, "word")
    levels = [cut(_first(counted.phrases), "phrases")]
    for length in range(2, longest + 1):
        columns = ["hashes"] if length == 2 else ["prefixes", "suffixes"]
        marked = lookup_join(relation.select("block", "places", *columns), counted.marks, "block", hot=False)

        def longer(rows: Iterable[tuple], counted: tuple = (counted.offsets, counted.kind, counted.sides)) -> Iterator[tuple]:
            offsets, kind, sides = counted
            for block, places, *packed, marks in rows:
                keys = np.frombuffer(packed[0], "<u8") if len(packed) == 1 else _key(*(_unpack(x, sides) for x in packed))
                marks = [{**m, "ranks": _unpack(m["ranks"], "<i4")} for m in marks or []]
                yield from _joined(block, _unpack(places, "<i4"), _ids(keys, marks, offsets, kind))

        relation, kind = kept(map_rows(marked, longer, _PHRASES), _PHRASES), counted.kind
        counted = _count(relation, least, kind)
        levels.append(cut(_named(counted.phrases.drop("word"), levels[-1]), "phrases"))

    candidates = None
    for level, above in zip(levels[1:], [*levels[2:], None], strict=True):
        own = level.select("id", "lang", "phrase", "a", "ls", "rs")
        if above is not None:  # what holds a phrase and occurs as often is, or holds, a phrase one word longer
            same = [above.where(F.col("a") == F.element_at("ls", -1)).select(F.col("prefix").alias("id")),
                    above.where(F.col("a") == F.element_at("rs", 1)).select(F.col("suffix").alias("id"))]
            gone = cut(same[0].unionByName(same[1]).distinct(), "held-phrases")
            own = lookup_join(own, gone, "id", "left_anti", hot=False)
        candidates = own if candidates is None else candidates.unionByName(own)
    scored = lookup_join(candidates, totals, "lang").withColumn("best", _lowest_cut())
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranked = top_n_per_group(scored, ["lang"], order, top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
