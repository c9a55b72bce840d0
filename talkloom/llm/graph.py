"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.runtime import cut, lookup_join


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, of every node in `edges` (columns a and b, 64-bit integers).

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours and itself; it ends
    when a round changes nothing. Loops and repeated edges do no harm, edges with a null end are left out.
    """
    edges = cut(_directed(edges.where("a IS NOT NULL AND b IS NOT NULL")), "components")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = lookup_join(both.where("b > a"), cut(least, "large-star"), "a")
        large = cut(_directed(large.select(F.col("b").alias("a"), F.col("least").alias("b"))), "large-star")
        least = cut(large.groupBy("a").agg(F.min("b").alias("least")), "small-star")
        small = lookup_join(large, least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = cut(_directed(small.unionByName(least.withColumnRenamed("least", "b"))), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())
