"""Shards that are runs along a Hilbert curve through metadata, with DataFrame functions only.

Each dimension is quantised at its own quantiles, so that frequent values take many cells; the cells' place on the curve
orders the rows, and the order is cut into runs of equal numbers of rows. Rows that are near in all dimensions are then in
the same or neighbouring files, and a file's smallest and largest values rule it out for most filters.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.runtime import cut

BITS = 5
# Relative rank error of the quantiles is 1 / ACCURACY.
ACCURACY = 10_000
# Bytes of a string, behind what all values begin with, that decide its cell.
PREFIX_BYTES = 6


def _numbers(df: DataFrame, dimensions: list[str]) -> list[Column]:
    """Each dimension as a number in the same order. Strings count by their bytes behind the common beginning."""
    texts = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    ends = [f(F.col(d)) for d in texts for f in (F.min, F.max)]
    found = iter(df.agg(*ends).first() if texts else ())
    numbers = []
    for d in dimensions:
        if d in texts:
            common = len(os.path.commonprefix([(next(found) or "").encode() for _ in range(2)]))
            rest = F.hex(F.substring(F.col(d).cast("binary"), common + 1, PREFIX_BYTES))
            numbers.append(F.conv(F.rpad(rest, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double"))
        elif isinstance(df.schema[d].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            numbers.append(F.unix_micros(F.col(d).cast("timestamp")).cast("double"))
        else:
            numbers.append(F.col(d).cast("double"))
    return numbers


def quantised(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """`df` with a column `_cell<i>` for each dimension: how many of its 2 ** bits - 1 quantiles a value exceeds. Nulls and
    numbers that aren't any are in cell 0."""
    numbers = [F.when(~F.isnan(n), n) for n in _numbers(df, dimensions)]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    limits = df.agg(*(F.percentile_approx(n, shares, ACCURACY) for n in numbers)).first()
    for i, (number, found) in enumerate(zip(numbers, limits, strict=True)):
        above = [F.when(number > F.lit(limit), 1).otherwise(0) for limit in found or ()]
        df = df.withColumn(f"_cell{i}", sum(above, F.lit(0)))
    return df


def curve_index(df: DataFrame, cells: list[str], bits: int, name: str) -> DataFrame:
    """`df` with the place of its cells on the Hilbert curve, the cells being consumed.

    The coordinates are turned into those of the curve bit by bit (Skilling 2004); each turn is a projection of its own,
    since it reads the one before several times.
    """
    x = list(cells)
    others = [c for c in df.columns if c not in cells]

    def step(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
        return df.select(*others, *(changed.get(c, F.col(c)).alias(c) for c in x))

    for bit in range(bits - 1, 0, -1):
        side, low = F.lit(1 << bit), F.lit((1 << bit) - 1)
        for i, c in enumerate(x):
            here = F.col(c).bitwiseAND(side) != 0
            swapped = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            first = F.when(here, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swapped))
            other = F.when(here, F.col(c)).otherwise(F.col(c).bitwiseXOR(swapped))
            df = step(df, {x[0]: first, c: other} if i else {c: F.when(here, F.col(c).bitwiseXOR(low)).otherwise(F.col(c))})
    for before, c in zip(x, x[1:]):
        df = step(df, {c: F.col(c).bitwiseXOR(F.col(before))})
    turn = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << bit)) != 0, (1 << bit) - 1).otherwise(0))
    df = df.select(*others, *x, turn.alias("_turn"))
    df = df.select(*others, *(F.col(c).bitwiseXOR(F.col("_turn")).alias(c) for c in x))
    place = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for c in x:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(F.col(c), bit).bitwiseAND(F.lit(1)).cast("bigint"))
    return df.select(*others, place.alias(name))


def hilbert_shards(df: DataFrame, dimensions: list[str], ties: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """`df` with `curve`, the rows' place on the curve, and `shard` and `slot`, gapless from 0 in curve order.

    Shards differ by one row at most. Rows at the same place go by the columns `ties`, and by the order in which they were
    read if these are equal too. Nulls in a dimension are in its first cell, nulls in `ties` come first. Repeated rows are
    all kept. With fewer rows than shards some shards stay empty; an empty table gives no rows.
    """
    kept = df.columns
    placed = curve_index(quantised(df, dimensions, bits), [f"_cell{i}" for i in range(len(dimensions))], bits, "_curve")
    placed = cut(placed.withColumn("_read", F.monotonically_increasing_id()), "hilbert-placed")
    ordered = placed.orderBy("_curve", *ties, "_read").withColumn("_at", F.monotonically_increasing_id())
    ordered = cut(ordered, "hilbert-ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    n = ordered.count()
    rank = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.join(F.broadcast(offsets), "_part").withColumn("_rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"(_rank * {shards}) div {max(n, 1)}").cast("int"))
    first = F.expr(f"(cast(shard AS bigint) * {n} + {shards - 1}) div {shards}")
    return ranked.select(*kept, F.col("_curve").alias("curve"), "shard", (F.col("_rank") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder per shard, its rows in the order of their slots."""
    dealt = sharded.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
