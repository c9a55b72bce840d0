"""Token files: concatenated ids in blocks, with Elias-Fano coded document boundaries.

Documents are sorted by id and encoded; a file holds blocks of some ten thousand ids, written by Spark as Parquet rows, so
that any store Spark reaches will do and a lost task leaves nothing behind. In a block, the ends of the documents and the
document ids are non-decreasing numbers in Elias-Fano form: low bits packed, high bits in unary with a sampled select
structure, about 2 + log2(universe / n) bits each in place of 64. Ids take two bytes if the vocabulary allows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.tables import map_rows
from talkloom.llm.tokens import END_ID, encoder, widened
from talkloom.runtime import cut, lookup_join

BLOCK_TOKENS = 1 << 16
BLOCK_DOCS = 1 << 14

_SEQUENCE = "{0}_n int, {0}_width int, {0}_low binary, {0}_high binary, {0}_samples binary"
BLOCKS = (
    "shard int, block int, n_docs int, n_tokens bigint, n_null int, first_doc bigint, last_doc bigint, id_bytes int, "
    f"{_SEQUENCE.format('ends')}, {_SEQUENCE.format('keys')}, ids binary"
)


@dataclass
class EliasFano:
    """Non-decreasing unsigned numbers."""

    n: int
    width: int  # low bits of each number
    low: bytes
    high: bytes
    samples: bytes  # place of each SAMPLE-th one in `high`, 32 bits each

    SAMPLE = 64

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, width, pack(bits), pack(high), places[:: cls.SAMPLE].astype("<u4").tobytes())

    def _lows(self, first: int, last: int) -> np.ndarray:
        start, stop = first * self.width, last * self.width
        data = np.frombuffer(self.low, np.uint8)[start // 8 : (stop + 7) // 8]
        bits = np.unpackbits(data, bitorder="little")[start % 8 : start % 8 + stop - start]
        bits = bits.reshape(last - first, self.width).astype(np.uint64)
        return (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from 0, reading the bits from the sample before it on."""
        place = int(np.frombuffer(self.samples, "<u4")[i // self.SAMPLE])
        missing, data = i % self.SAMPLE, np.frombuffer(self.high, np.uint8)
        at, skip = place // 8, place % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(data[at : at + 64], bitorder="little")[skip:])
            if missing < len(ones):
                place = at * 8 + skip + int(ones[missing])
                break
            missing -= len(ones)
            at, skip = at + 64, 0
        return (place - i << self.width) | int(self._lows(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        highs = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        return highs | self._lows(0, self.n)

    def fields(self) -> tuple:
        return self.n, self.width, self.low, self.high, self.samples


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode the texts and write them to `path` in ascending order of doc_id.

    Null ids come first, rows with equal ids in the order of a hash of their texts; repeated rows are all written. A null
    or empty text has the end id alone. An empty table gives a file without blocks. Other columns are not read.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        encode = encoder(tokenizer, end_id)
        shard, block = TaskContext.get().partitionId(), 0
        keys, parts, size = [], [], 0
        for key, data in rows:
            ids = encode(data)
            keys.append(key)
            parts.append(ids)
            size += len(ids)
            if size >= block_tokens * encode.dtype.itemsize or len(keys) >= BLOCK_DOCS:
                yield _block(shard, block, keys, parts, encode.dtype)
                keys, parts, size, block = [], [], 0, block + 1
        if keys:
            yield _block(shard, block, keys, parts, encode.dtype)
        encode.forget()

    keyed = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("binary").alias("text"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    map_rows(ordered, run, BLOCKS).write.parquet(path)


def _block(shard: int, block: int, keys: list, parts: list[bytes], dtype: np.dtype) -> tuple:
    known = np.array([k for k in keys if k is not None], np.int64)
    first, last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    ends = np.cumsum([len(p) // dtype.itemsize for p in parts])
    steps = known.astype(np.uint64) - known[:1].astype(np.uint64)  # differences of 64-bit ids fit without a sign
    return (
        shard, block, len(keys), int(ends[-1]), len(keys) - len(known), first, last, dtype.itemsize,
        *EliasFano.of(ends).fields(), *EliasFano.of(steps).fields(), b"".join(parts),
    )


def _coded(row: tuple) -> tuple[list, EliasFano, bytes, np.dtype]:
    n_null, first, width, ids = row[4], row[5], row[7], row[18]
    keys = [None] * n_null
    if first is not None:
        keys += (EliasFano(*row[13:18]).decode() + np.uint64(first & (1 << 64) - 1)).astype(np.int64).tolist()
    return keys, EliasFano(*row[8:13]), ids, np.dtype(f"<u{width}")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit integers)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    starts = cut(block_starts(blocks), "token-starts")
    placed = lookup_join(blocks, starts, ["shard", "block"], hot=False).select(*blocks.columns, "first")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            keys, coded, ids, dtype = _coded(row)
            ends = coded.decode().astype(np.int64)
            for key, start, end in zip(keys, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                part = ids[start * dtype.itemsize : end * dtype.itemsize]
                yield key, row[-1] + start, end - start, widened(part, dtype)

    return map_rows(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each block. One window runs over the blocks of a shard, one over one row per shard."""
    before = lambda *group: Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select(
        "shard", "block", F.coalesce(F.sum("n_tokens").over(before("shard").orderBy("block")), F.lit(0)).alias("_inner")
    )
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    starts = totals.select("shard", F.coalesce(F.sum("_n").over(before().orderBy("shard")), F.lit(0)).alias("_shard"))
    return inside.join(starts, "shard").select("shard", "block", (F.col("_shard") + F.col("_inner")).alias("first"))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Single documents by id: blocks are pruned by their id range, boundaries found by select. doc_id, ids."""
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(BLOCKS).parquet(path)
    inside = F.lit(False)
    for key in wanted:
        inside = inside | ((F.col("first_doc") <= key) & (F.col("last_doc") >= key))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row in rows:
            keys, ends, ids, dtype = _coded(row)
            for i, key in enumerate(keys):
                if key in wanted:
                    start = ends.select(i - 1) if i else 0
                    yield key, widened(ids[start * dtype.itemsize : ends.select(i) * dtype.itemsize], dtype)

    return map_rows(blocks.where(inside), run, "doc_id bigint, ids binary")
