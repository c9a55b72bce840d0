"""Reading nested chat logs, writing tables and features."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.runtime import dense_index

# Columns of the raw logs that the analysis never uses, and the message fields it does use.
UNUSED_COLUMNS = ["toxic", "timestamp", "redacted", "openai_moderation", "detoxify_moderation"]
MESSAGE_FIELDS = ["content", "role", "language", "timestamp", "turn_identifier"]


def message_fields(df: DataFrame, column: str = "conversation") -> list[str]:
    """Names of the fields of the structs inside a list column; reads the schema only."""
    return df.schema[column].dataType.elementType.names


def _narrow(schema: T.StructType, drop: list[str], keep_fields: list[str] | None) -> T.StructType:
    fields = []
    for field in schema.fields:
        if field.name in drop:
            continue
        if field.name == "conversation" and keep_fields is not None:
            element = field.dataType.elementType
            kept = T.StructType([f for f in element.fields if f.name in keep_fields])
            field = T.StructField(field.name, T.ArrayType(kept, field.dataType.containsNull), field.nullable)
        fields.append(field)
    return T.StructType(fields)


def scan_raw(
    spark: SparkSession,
    paths: str | list[str],
    language: str | None = "English",
    keep_fields: list[str] | None = MESSAGE_FIELDS,
    drop: list[str] = UNUSED_COLUMNS,
) -> DataFrame:
    """Raw conversations in one language from one file, a glob or a list of paths.

    Spark does not prune struct fields below an `explode`, so the scan is given a schema without them: unused
    message fields never leave the files. The language filter is pushed to the Parquet row groups.
    """
    paths = [paths] if isinstance(paths, str) else paths
    schema = _narrow(spark.read.parquet(*paths).schema, drop, keep_fields)
    df = spark.read.schema(schema).parquet(*paths)
    if language is not None:
        df = df.where(F.col("language") == language)
    return df.withColumnRenamed("language", "lang_conv")


def scan_columns(
    spark: SparkSession, path: str, columns: list[str], limit: int | None = None, order: str | None = None
) -> DataFrame:
    """Projected scan; `limit` takes any n rows, as a quick look does, or with `order` the first n by that column. The n-th
    value is found from that column alone, so that other columns are not sorted."""
    df = spark.read.parquet(path).select(*columns)
    if limit is None or order is None:
        return df if limit is None else df.limit(limit)
    below = df.select(order).orderBy(order).limit(limit).agg(F.max(order), F.count("*")).first()
    if below[1] < limit:
        return df
    return df.where(F.col(order).isNull() | (F.col(order) <= below[0])).orderBy(order).limit(limit)


def query_file(spark: SparkSession, path: str, sql: str, **params) -> DataFrame:
    """Run SQL over `{source}` = the Parquet files at `path`, with named parameters (`:name`)."""
    return spark.sql(sql, args=params, source=spark.read.parquet(path))


def query_frame(df: DataFrame, sql: str, name: str = "frame") -> DataFrame:
    """Run SQL that refers to a DataFrame as `{name}`."""
    return df.sparkSession.sql(sql, **{name: df})


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 1_000_000) -> None:
    """Write Parquet; files are cut by row count and no shuffle is added."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Save `(term, idx)` as JSON lines in UTF-8; the index keeps the order across files."""
    vocabulary.select("term", "idx").write.mode(mode).json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Load a saved vocabulary, or a JSON array of terms (one document), as `(term, idx)`."""
    lines = spark.read.schema("term string, idx bigint").json(path)
    if lines.where(F.col("term").isNotNull()).limit(1).count():
        return lines
    terms = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "array<string>")).alias("term")
    )
    return dense_index(terms.distinct(), "term")


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> str:
    """Hash of the input files (names, sizes and times of change; nothing of them is read) and the parameters."""
    known = "path string, modificationTime timestamp, length bigint, content binary"
    state = hashlib.sha256(json.dumps(parameters or {}, sort_keys=True, default=str).encode())
    for path in sorted(inputs):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(known).load(path)
        line = F.concat_ws(" ", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
        # A number per file is added up, so that any number of files needs no list on the driver.
        low, high = (F.sum(F.xxhash64(F.lit(i), line).cast("decimal(20,0)")) for i in (0, 1))
        state.update(repr((path, *files.agg(F.count("*"), low, high).first())).encode())
    return state.hexdigest()


def load_or_compute(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: list[str] | None = None,
    parameters: dict | None = None,
) -> DataFrame:
    """The feature table below `path` that was built from the same `inputs` (paths) with the same parameters; if there is
    none, it is built, saved and read.

    Each build has a folder of its own, named by a manifest that is written last: changed inputs or parameters give another
    table, and a build that was interrupted has no manifest and is made anew.
    """
    manifest = f"{path}/manifest-{fingerprint(spark, inputs or [], parameters)}"
    known = "folder string, kind string"
    try:
        found = spark.read.schema(known).json(manifest).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        table, folder = build(), f"data-{uuid.uuid4().hex}"
        write_table(table, f"{path}/{folder}")
        row = [(folder, table.schema.json())]
        spark.createDataFrame(row, known).coalesce(1).write.mode("overwrite").json(manifest)
        found = row[0]
    folder, kind = found
    return spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(f"{path}/{folder}")
