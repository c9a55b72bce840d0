"""Blocks of token lists, for lookup tables that are too large to send to every task.

The tokens of a table are not joined to the lookup table, but the different tokens of each block, which are several times
fewer. A block and what its tokens fetched then meet in one task. A token comes once a block, so no key is hot, and lists are
shuffled whole, once, as both uses of the blocks share that shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.runtime import lookup_join

# Tokens of a block, about, and the fewest that are worth a block of their own while tasks are idle.
BLOCK_TOKENS, LEAST_TOKENS = 1 << 20, 1 << 17


def deal(docs: DataFrame, tokens: str, by: Column, keep: list[Column | str], total: int | None = None) -> DataFrame:
    """`(_block, *keep, _joined, _sizes)`: token lists as a string and the bytes of each token, -1 for null. Rows that agree
    in `by` share a block. Tokens are counted unless about how many there are in total is given."""
    total = docs.agg(F.sum(F.size(tokens))).first()[0] or 0 if total is None else total
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-total // BLOCK_TOKENS), min(2 * partitions, total // LEAST_TOKENS))
    sizes = F.transform(tokens, lambda t: F.coalesce(F.octet_length(t), F.lit(-1)))
    joined = F.array_join(tokens, "")
    return docs.select(F.pmod(by, F.lit(n_blocks)).alias("_block"), *keep, joined.alias("_joined"), sizes.alias("_sizes"))


def opened(table):
    """Of a block, an Arrow table: the tokens of all lists in turn, and the row of each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined, lists = table["_joined"].combine_chunks(), table["_sizes"].combine_chunks()
    sizes = lists.flatten().to_numpy(zero_copy_only=False)
    _, places, text = joined.buffers()
    first = np.frombuffer(places, np.int32)[joined.offset] if len(joined) else 0
    offsets = np.append(0, np.cumsum(np.maximum(sizes, 0), dtype=np.int64)) + first
    valid = pa.py_buffer(np.packbits(sizes >= 0, bitorder="little").tobytes())
    flat = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), text or pa.py_buffer(b""), valid)
    return flat, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(table):
    """Of a block: row and code of each token that is not null, and the tokens by code."""
    flat, row = opened(table)
    codes = flat.drop_null().dictionary_encode()
    row = row[flat.is_valid().to_numpy(zero_copy_only=False)]
    return row, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary


def fetch(blocks: DataFrame, table: DataFrame, token: str) -> DataFrame:
    """Rows of `table`, which is unique on `token`, for each block that has the token: `_block` and the table's columns."""

    def different(key, rows):
        import pyarrow as pa

        tokens = coded(rows)[2]
        return pa.table({"_block": pa.repeat(key[0], len(tokens)), token: tokens})

    found = blocks.groupBy("_block").applyInArrow(different, f"_block bigint, `{token}` string")
    return lookup_join(found, table, token, hot=False)
