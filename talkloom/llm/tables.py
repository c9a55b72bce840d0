"""Passing rows between Spark's Arrow batches and Python, and the columns the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from talkloom.runtime import cut, lookup_join

# Rows become Python values in parts of this many bytes or rows, so that a batch of long texts stays small.
PART_BYTES, PART_ROWS = 4 << 20, 256
# Spark sends batches of so many bytes to Python.
BATCH_BYTES, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
# Rows made in Python return in batches of this many bytes or rows.
OUT_BYTES, OUT_ROWS = 4 << 20, 8192


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: str = "text") -> Column:
    return F.col(column).cast("binary")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples of Python values, a few at a time."""
    for batch in batches:
        step = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= OUT_BYTES or len(held) >= OUT_ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def release_memory() -> None:
    """Give freed memory back to the system, as Spark uses a worker for many tasks. Only the GNU library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_rows(
    df: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType
) -> DataFrame:
    """`function` on each partition's rows, as tuples; `schema` names its results.

    Where Spark limits the bytes of a batch, the session's limit of 64 MB is set to BATCH_BYTES.
    """
    if df.sparkSession.conf.get(_BATCH_KEY, None) == "67108864b":
        df.sparkSession.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(function(rows_of(batches)), arrow)
        release_memory()

    return df.mapInArrow(run, kind)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text as UTF-8 bytes, and row_key: a hash of both, equal for repeated rows only."""
    return docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"),
        docs[text].cast("binary").alias("text"),
        row_key(docs, doc_id, text).alias("row_key"),
    )


def row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(docs[doc_id].cast("bigint"), docs[text].cast("binary"))


def without(docs: DataFrame, found: DataFrame, gone: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows whose row_key has `gone` true in `found`. All columns stay."""
    keys = cut(found.where(gone).select(F.col("row_key").alias("_llm_row_key")).distinct(), "gone")
    marked = docs.withColumn("_llm_row_key", row_key(docs, doc_id, text))
    return lookup_join(marked, keys, "_llm_row_key", "left_anti", hot=False).select(*docs.columns)
