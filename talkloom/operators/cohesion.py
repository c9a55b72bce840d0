"""Mean and deviation of pairwise cosines on long tables of unit rows, without forming pairs of rows.

The squared cosines of all pairs of a cluster's rows add up to the squared norm of M, the sum of the rows' outer products. M
has a cell per pair of terms. The exact form adds up those cells; the sketch adds up tensor sketches of the outer products,
which are `width` numbers whatever the vocabulary and whose squared norm has that of M as its mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.profile import cohesion_of_cells
from talkloom.runtime import cut


def _exact_norms(packed: DataFrame) -> DataFrame:
    """Squared norm of M by cluster, from the pairs of terms of each row."""
    rows = packed.select("cluster", "doc_id", F.inline("_x"))
    other = rows.select("doc_id", F.col("term").alias("other"), F.col("w").alias("v"))
    cells = rows.join(other, "doc_id").where("term <= other").groupBy("cluster", "term", "other")
    cells = cells.agg(F.sum(F.col("w") * F.col("v")).alias("m"))
    square = F.col("m") * F.col("m") * F.when(F.col("term") == F.col("other"), 1.0).otherwise(2.0)
    return cells.groupBy("cluster").agg(F.sum(square).alias("norm"), F.lit(0.0).alias("error"))


def _sketched_norms(rows: DataFrame, width: int, repeats: int, seed: int) -> DataFrame:
    """The same by `repeats` independent tensor sketches: their mean and its standard error. A task sends `repeats` times
    `width` numbers for each of its clusters. Terms are hashed where the rows lie."""
    salts = [f"{seed}:{r}:{side}" for r in range(repeats) for side in (0, 1)]
    hashes = F.transform("_x.term", lambda term: F.array(*[F.xxhash64(F.lit(salt), term) for salt in salts]))
    packed = rows.select("cluster", F.col("_x.w").alias("w"), F.flatten(hashes).alias("h"))

    def run(batches):
        import pandas as pd

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cluster, w, h in zip(batch["cluster"], batch["w"], batch["h"], strict=True):
                cells = np.asarray(h, np.int64).view(np.uint64).reshape(-1, 2 * repeats).T
                sums = total.setdefault(cluster, np.zeros((repeats, width)))
                signed = [np.asarray(w) * np.where(c >> np.uint64(63), 1.0, -1.0) for c in cells]
                place = (cells % np.uint64(width)).astype(np.int64)
                one = np.array([np.bincount(p, s, width) for p, s in zip(place, signed, strict=True)])
                spectrum = np.fft.rfft(one)
                sums += np.fft.irfft(spectrum[0::2] * spectrum[1::2], width)
        for cluster, sums in total.items():
            yield pd.DataFrame({"cluster": cluster, "repeat": range(repeats), "sketch": list(sums)})

    kind = rows.schema["cluster"].dataType.simpleString()
    sent = packed.mapInPandas(run, f"cluster {kind}, repeat int, sketch array<double>")
    cells = sent.select("cluster", "repeat", F.posexplode("sketch")).groupBy("cluster", "repeat", "pos")
    squares = cells.agg(F.sum("col").alias("m")).groupBy("cluster", "repeat")
    norms = squares.agg(F.sum(F.col("m") * F.col("m")).alias("norm")).groupBy("cluster")
    error = F.coalesce(F.stddev_samp("norm"), F.lit(0.0)) / np.sqrt(repeats)
    return norms.agg(F.avg("norm").alias("norm"), error.alias("error"))


def cluster_cohesion_terms(
    weights: DataFrame, labels: DataFrame, width: int | None = 4096, repeats: int = 8, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """`(cluster, n, mean_cosine, std_cosine, mean_square, error)` of all pairs of a cluster's rows, noise included.

    `weights` are unit rows `(doc_id, term, w)`; a row without terms has cosine 0 with all. `mean_square` is the mean of the
    squared cosines and `error` its standard error, which falls with the root of width times repeats; the population deviation
    follows from it and the exact mean. `width=None` is exact (error 0) and makes a row per pair of a row's terms, so it is
    for small clusters. Null for a single row.
    """
    own = labels.select(F.col(key).alias("doc_id"), "cluster")
    # The weights are made and shuffled once: by row, which the labels are joined by.
    joined = weights.select("doc_id", "term", "w").join(own, "doc_id").groupBy("doc_id", "cluster")
    rows = cut(joined.agg(F.collect_list(F.struct("term", "w")).alias("_x")), "cohesion-rows")
    norms = _exact_norms(rows) if width is None else _sketched_norms(rows, width, repeats, seed)
    x2 = F.aggregate("_x.w", F.lit(0.0), lambda total, w: total + w * w)
    fourth = rows.select("cluster", x2.alias("x2")).groupBy("cluster").agg(F.sum(F.col("x2") * F.col("x2")).alias("x4"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    means = cohesion_of_cells(sizes, rows.select("cluster", F.inline("_x")))
    found = means.join(norms, "cluster", "left").join(fourth, "cluster", "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    square = F.when(F.col("n") > 1, F.coalesce(F.greatest(F.col("norm") - F.col("x4"), F.lit(0.0)) / 2, F.lit(0.0)) / pairs)
    error = F.when(F.col("n") > 1, F.coalesce(F.col("error") / 2, F.lit(0.0)) / pairs)
    found = found.withColumn("mean_square", square).withColumn("error", error)
    spread = F.sqrt(F.greatest(F.col("mean_square") - F.col("mean_cosine") * F.col("mean_cosine"), F.lit(0.0)))
    deviation = F.when(F.col("n") > 1, spread)
    return found.select("cluster", "n", "mean_cosine", deviation.alias("std_cosine"), "mean_square", "error")
