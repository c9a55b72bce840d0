"""Building blocks shared by the operators: lineage cuts, sized joins, per-group top-n, dense index."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes up to which a lookup side is broadcast, whatever the size of the data.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20

# Copies made of a lookup side that is too large to broadcast: at least so many, and one for each PARTITIONS_PER_SALT
# shuffle partitions. A hot key is spread over as many tasks.
SALTS, PARTITIONS_PER_SALT = 16, 32


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: `spark.checkpoint.dir`, or the context's checkpoint folder, which is made in local
    mode if there is none."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="talkloom-"))
        configured = context.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir, when the session is built, to a folder that every executor can reach")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


# For rows of megabytes: Parquet otherwise looks at the size of a page and of a row group every hundred rows only, and holds all up
# to there several times over.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20),
}


def cut(df: DataFrame, label: str, path: str | None = None, large_rows: bool = False) -> DataFrame:
    """Write `df` to the shared folder (or to `path`) and read it back.

    The plan restarts from files that outlive executors, runs once however often it is used, and its
    real size is known to the planner for later joins.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, 8 for one of fixed width. One of variable width has 8 for its place and is filled up
    to 8, which is most of a list of short words."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16).cast("bigint") + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        of = lambda total, x: total + _held_bytes(x, kind.elementType)
        return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), of), F.lit(0)).cast("bigint")
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return _held_bytes(F.map_keys(value), keys) + _held_bytes(F.map_values(value), values)
    if isinstance(kind, T.StructType):
        return sum((_held_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    if isinstance(kind, T.UserDefinedType):
        return _held_bytes(F.unwrap_udt(value), kind.sqlType())
    return F.lit(8).cast("bigint")


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if `df` has at most `limit` rows, and its values of variable width at most BROADCAST_BYTES. Without such
    columns counting a cut reads file footers only."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    sizes = [F.sum(_held_bytes(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema if not isinstance(f.dataType, fixed)]
    counted = df.agg(F.count("*"), *sizes).first()
    return counted[0] <= limit and sum(s or 0 for s in counted[1:]) <= BROADCAST_BYTES


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
    hot: bool = True,
) -> DataFrame:
    """Join a large table to a lookup table that is unique on `on`.

    The lookup is broadcast only after its size was checked; otherwise it is copied once per salt and
    the left side spread over the salts, so that a hot key is shared by many tasks. Keys that cannot be hot, such
    as row ids, need no copies (`hot=False`). `right` should be a cut or a scan because it is measured here.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), keys, how)
    if not hot:
        return left.join(right, keys, how)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(SALTS, partitions // PARTITIONS_PER_SALT)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows of each group, numbered from 1.

    `row_number() <= n` makes Spark keep only n rows per group in each task before the shuffle (window group
    limit), which is what protects a hot group. That rewrite stops at `windowGroupLimitThreshold`; above it the
    same cut is made by hand on salted sub-groups first.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        within = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= n).drop("_r", "_salt")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def dense_index(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """Number the rows 0..n-1 in the order of the unique column `order`, without a one-task window.

    The sorted table is cut first, so that partition numbers and offsets come from the same execution; only one
    row per partition is ranked globally.
    """
    numbered = cut(df.orderBy(order).withColumn("_mid", F.monotonically_increasing_id()), "dense-index")
    numbered = numbered.withColumn("_part", F.shiftright("_mid", 33))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_mid", "_part", "_offset")
    )
