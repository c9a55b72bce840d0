"""Hashes of blocks of documents, compared across all blocks.

Documents are written once in blocks. A block sends its different hashes, sorted, to the buckets of the hash space as packed
arrays, and a bit per hash comes back. A hash costs eight bytes in the shuffle, and one that occurs in a third of all
documents costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from talkloom.llm.tables import map_rows, release_memory, row_key
from talkloom.llm.words import chunks
from talkloom.runtime import cut, scratch_path

BLOCK_BYTES = 1 << 18
# Bytes of hashes in a bucket.
BUCKET_BYTES = 8 << 20
# Blocks of a row group, since a reader holds one as a whole.
_ROW_GROUPS = {"parquet.block.row.count.limit": 16}
# Order of a null doc_id: before all others.
FIRST = np.iinfo(np.int64).min


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents in blocks, each sorted by doc_id: block, doc_ids, row_keys, texts, n_bytes, and rest, structs of the
    other columns of `docs` (null if there are none)."""
    others = [docs[c] for c in docs.columns if c not in (doc_id, text)]
    rest = (F.struct(*others) if others else F.lit(None).cast("boolean")).alias("rest")
    wide = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("binary").alias("text"),
        row_key(docs, doc_id, text).alias("row_key"), rest,
    )
    schema = StructType.fromDDL("block bigint, doc_ids array<bigint>, row_keys array<bigint>, texts array<binary>")
    schema = schema.add("n_bytes", LongType()).add("rest", ArrayType(wide.schema["rest"].dataType))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 33
        for held in chunks(rows, text=1, limit=BLOCK_BYTES):
            held.sort(key=lambda r: FIRST if r[0] is None else r[0])
            keys, texts, row_keys, others = map(list, zip(*held, strict=True))
            yield number, keys, row_keys, texts, sum(len(t or b"") for t in texts), others
            number += 1

    path = scratch_path(docs.sparkSession, "blocks")
    map_rows(wide, run, schema).write.options(**_ROW_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def n_buckets_for(blocks: DataFrame, hashes_per_byte: float) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shuffled = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffled, int(8 * hashes_per_byte * total / BUCKET_BYTES) + 1)


def order_of(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([FIRST if d is None else d for d in doc_ids], np.int64)


def slices(values: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted hashes: equal parts of the hash space. Those without hashes are left out."""
    bucket = ((values >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        if low < high:
            yield int(bucket[low]), slice(low, high)


def bits(found: list[dict] | None, values: np.ndarray, n_buckets: int) -> np.ndarray:
    """One bit per hash of a block, from what the buckets sent back."""
    mask = np.zeros(len(values), bool)
    sent = {x["bucket"]: x["bits"] for x in found or []}
    for bucket, part in slices(values, n_buckets):
        if bucket in sent:
            mask[part] = np.unpackbits(np.frombuffer(sent[bucket], np.uint8))[: part.stop - part.start]
    return mask


def twice(group: pd.DataFrame) -> Iterator[tuple]:
    """Hashes that more than one block sent."""
    values = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    _, index, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    return _returned(group, counts[index] > 1, [len(v) for v in values])


def not_first(group: pd.DataFrame) -> Iterator[tuple]:
    """Hashes that another block sent with a smaller document, or an equal one in an earlier block."""
    values = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    sizes = [len(v) for v in values]
    hashes, block = np.concatenate(values), np.repeat(group["block"].to_numpy(), sizes)
    doc = np.concatenate([np.frombuffer(d, np.int64) for d in group["docs"]])
    order = np.lexsort((block, doc, hashes))
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    return _returned(group, later, sizes)


def _returned(group: pd.DataFrame, mask: np.ndarray, sizes: list[int]) -> Iterator[tuple]:
    ends = np.cumsum(sizes)
    for bucket, block, end, size in zip(group["bucket"], group["block"], ends, sizes, strict=True):
        if (own := mask[end - size : end]).any():
            yield bucket, block, np.packbits(own).tobytes()


def exchange(sent: DataFrame, judge: Callable[[pd.DataFrame], Iterator[tuple]], label: str) -> DataFrame:
    """Bits of each block, by bucket, as one list."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(list(judge(group)), columns=["bucket", "block", "bits"])
        release_memory()
        return found

    judged = sent.groupBy("bucket").applyInPandas(run, "bucket int, block bigint, bits binary")
    return cut(judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(label)), label)
