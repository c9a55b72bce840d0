"""Reproducible samples: rows are ranked by the md5 of seed and key, which is the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.runtime import cut, lookup_join, top_n_per_group

_PREFIX = 4  # hex digits per refinement: at most 65,536 counts reach the driver
_FEW = 4096  # hashes sorted at the end


def sample_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _size(size: int | None, fraction: float | None) -> None:
    if (size is None) == (fraction is None):
        raise ValueError("give exactly one of size and fraction")


def sample_exact(
    df: DataFrame, key: str, *, size: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Exactly `size` (or `int(n * fraction)`) rows, uniformly and without replacement; `key` is unique.

    The size-th smallest hash is found by counting hash prefixes, digit group by digit group. The sample is then a
    plain filter on the table: nothing is sorted or shuffled, and rows are not moved.
    """
    _size(size, fraction)
    hashes = df.select(sample_hash(key, seed).alias("h"))
    prefix, wanted = "", size
    while True:
        inside = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes
        digits = len(prefix) + _PREFIX
        counts = inside.groupBy(F.substring("h", 1, digits).alias("p")).count().orderBy("p").collect()
        if wanted is None:
            wanted = int(sum(r["count"] for r in counts) * fraction)
        if not prefix and wanted >= sum(r["count"] for r in counts):
            return df
        if wanted <= 0:
            return df.where(F.lit(False))
        for row in counts:
            if wanted <= row["count"]:
                break
            wanted -= row["count"]
        prefix = row["p"]
        if row["count"] <= _FEW or digits >= 32:
            break
    last = hashes.where(F.col("h").startswith(prefix)).orderBy("h").limit(wanted).agg(F.max("h")).first()[0]
    return df.where(sample_hash(key, seed) <= last)


def rows_with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(keys.select(key), key, "left_semi")


def sample_per_cluster(
    df: DataFrame, labels: DataFrame, text: str, n: int, key: str = "doc_id", seed: int = 42, prefix: int = 500
) -> DataFrame:
    """`min(n, size)` random rows of each cluster with the first characters of their text, noise left out.

    Keys are drawn first; texts are joined to the few drawn keys.
    """
    candidates = labels.where(F.col("cluster") != -1).select(key, "cluster").withColumn("_h", sample_hash(key, seed))
    drawn = cut(top_n_per_group(candidates, ["cluster"], [F.col("_h"), F.col(key)], n).drop("_h"), "drawn")
    excerpt = df.select(key, F.substring(text, 1, prefix).alias("excerpt"))
    return lookup_join(excerpt, drawn, key, hot=False).select("cluster", "rank", key, "excerpt")
