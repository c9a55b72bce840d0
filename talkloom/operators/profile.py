"""Describe clusters. Labels are `(key, cluster)` with -1 for noise, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.vectors import unit
from talkloom.runtime import cut, lookup_join, top_n_per_group

NOISE = -1
# Guard against division by zero, and the panels a grid of clusters usually shows.
EPSILON = 1e-10
PANELS = 20


def n_clusters(labels: DataFrame) -> int:
    """Number of clusters without noise."""
    return labels.where(F.col("cluster") != NOISE).select("cluster").distinct().count()


def select_clusters(labels: DataFrame, clusters: str | int | list[int] = "all") -> Column | None:
    """Condition for the chosen clusters. "all" is 0 .. n-1 and so never includes noise."""
    if isinstance(clusters, int) and not isinstance(clusters, bool):
        clusters = [clusters]
    if clusters == "all":
        return F.col("cluster") != NOISE
    if not isinstance(clusters, list):
        raise TypeError(f"clusters must be 'all', an int or a list of ints, not {type(clusters).__name__}")
    n = n_clusters(labels)
    for c in clusters:
        if not 0 <= c < n:
            raise ValueError(f"cluster {c} is out of range 0-{n - 1}")
    return F.col("cluster").isin(clusters)


def labels_to_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with their label, aligned by key."""
    return df.join(labels.select(key, "cluster"), key)


def cluster_sizes(labels: DataFrame, clusters: str | int | list[int] = "all") -> DataFrame:
    """Rows per cluster and share of all rows, noise counted in the total."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy())  # over one row per cluster
    return sizes.withColumn("share", F.col("n") / everything).where(select_clusters(labels, clusters))


def noise_summary(labels: DataFrame) -> DataFrame:
    """One row: number of clusters, rows and per cent noise; from one row per cluster."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    noise = F.sum(F.when(F.col("cluster") == NOISE, F.col("n")).otherwise(0))
    return sizes.agg(
        F.count(F.when(F.col("cluster") != NOISE, 1)).alias("n_clusters"),
        F.sum("n").alias("n_rows"),
        (noise * 100.0 / F.sum("n")).alias("noise_pct"),
    )


def top_clusters_by_size(labels: DataFrame, n: int = PANELS, hide_noise: bool = True) -> DataFrame:
    """The largest clusters `(cluster, n)`, ties by number."""
    shown = without_noise(labels) if hide_noise else labels
    return shown.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(n)


def without_noise(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cluster") != NOISE)


def plot_data(points: DataFrame, labels: DataFrame, key: str = "doc_id", hide_noise: bool = True) -> DataFrame:
    """`(key, x, y, cluster)` for a scatter plot."""
    joined = labels_to_rows(points.select(key, "x", "y"), labels, key)
    return without_noise(joined) if hide_noise else joined


def grid_bounds(data: DataFrame) -> DataFrame:
    """Common axis limits of all panels."""
    return data.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("x", "y") for f in (F.min, F.max)])


def cluster_mean(weights: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Column means within clusters `(cluster, term, mean_w)`; rows without terms count in the size.

    Sums are reduced per (cluster, term) in each task, so a cluster with a third of the rows is no hot spot.
    """
    sizes = cut(labels.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    sums = weights.join(labels.select(F.col(key).alias("doc_id"), "cluster"), "doc_id")
    sums = sums.groupBy("cluster", "term").agg(F.sum("w").alias("total"))
    return lookup_join(sums, sizes, "cluster").select("cluster", "term", (F.col("total") / F.col("n")).alias("mean_w"))


def _top(scores: DataFrame, score: str, n: int, digits: int) -> DataFrame:
    rounded = scores.withColumn(score, F.round(score, digits))
    return top_n_per_group(rounded, ["cluster"], [F.desc(score), F.col("term")], n)


def top_tfidf_terms(
    weights: DataFrame, labels: DataFrame, n: int = 15, clusters: str | int | list[int] = "all",
    key: str = "doc_id", digits: int = 6, means: DataFrame | None = None,
) -> DataFrame:
    """The n terms with the highest mean weight in each cluster; ties by term, on the rounded score. Give the cluster
    means if they were made before."""
    means = cluster_mean(weights, labels, key) if means is None else means
    return _top(means.where(select_clusters(labels, clusters)), "mean_w", n, digits)


def most_overrepresented_terms(
    weights: DataFrame, labels: DataFrame, n: int = 15, clusters: str | int | list[int] = "all",
    key: str = "doc_id", digits: int = 4, means: DataFrame | None = None,
) -> DataFrame:
    """The n terms with the highest ratio of cluster mean to overall mean.

    The weights are read and joined once: overall sums come from the cut cluster means.
    """
    sizes = cut(labels.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    means = cut(cluster_mean(weights, labels, key), "means") if means is None else means
    n_rows = sizes.agg(F.sum("n")).first()[0]
    sums = lookup_join(means, sizes, "cluster").withColumn("total", F.col("mean_w") * F.col("n"))
    overall = sums.groupBy("term").agg((F.sum("total") / n_rows).alias("overall"))
    ratio = F.col("mean_w") / (F.col("overall") + EPSILON)
    scored = means.where(select_clusters(labels, clusters)).join(overall, "term")
    return _top(scored.select("cluster", "term", ratio.alias("ratio")), "ratio", n, digits)


def nearest_point(points: DataFrame, labels: DataFrame, x: float, y: float, key: str = "doc_id", radius: float = 20.0):
    """The labelled point nearest to (x, y), its distance, and how many points of its cluster lie within `radius`."""
    data = labels_to_rows(points.select(key, "x", "y"), labels, key)
    data = data.withColumn("distance", F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)))
    nearest = data.orderBy("distance", key).limit(1)
    near = data.where(F.col("distance") < radius).groupBy("cluster").agg(F.count("*").alias("n_near"))
    return nearest.join(near, "cluster", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))


def cluster_cohesion_mean(weights: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean pairwise cosine per label, noise included, from unit TF-IDF rows and without forming pairs:
    (|sum of rows|^2 - sum of |row|^2) / 2 over n(n-1)/2. Null for a single row."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return cohesion_of_cells(sizes, weights.join(labels.select(F.col(key).alias("doc_id"), "cluster"), "doc_id"))


def cohesion_of_cells(sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """The same from the clusters' sizes `(cluster, n)` and labelled weights `(cluster, term, w)`."""
    by_term = cells.groupBy("cluster", "term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    sums = by_term.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.when(F.col("n") > 1, F.coalesce((F.col("s2") - F.col("q")) / 2, F.lit(0.0)) / pairs)
    return sizes.join(sums, "cluster", "left").select("cluster", "n", mean.alias("mean_cosine"))


def cluster_cohesion(points: DataFrame, labels: DataFrame, key: str, vec: str) -> DataFrame:
    """Size, mean and population standard deviation of pairwise cosine per label, noise included.

    With unit rows X of a label: the sum of squared pair cosines is (|X'X|^2 - sum |x|^4) / 2. Each task adds up
    X'X (dimensions squared, whatever the rows) per label; no pair of rows is formed. Zero rows count as cosine 0.
    """
    rows = points.select(key, unit(vec).alias("vec")).join(labels.select(key, "cluster"), key)

    def moments(batches):
        import numpy as np
        import pandas as pd

        state = {}
        for batch in batches:
            for cluster, part in batch.groupby("cluster"):
                x = np.array(part["vec"].tolist())
                sq = (x * x).sum(axis=1)
                new = [len(x), x.sum(axis=0), sq.sum(), x.T @ x, (sq * sq).sum()]
                old = state.get(cluster)
                state[cluster] = new if old is None else [a + b for a, b in zip(old, new)]
        for cluster, (n, s, q, gram, q2) in state.items():
            d = len(s)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"cluster": cluster, "i": i, "j": j, "g": gram.ravel(), "s": np.where(i == j, s[i], 0.0),
                                "n": np.where(i + j == 0, n, 0), "q": np.where(i + j == 0, q, 0.0),
                                "q2": np.where(i + j == 0, q2, 0.0)})

    cells = rows.select("cluster", "vec").mapInPandas(
        moments, "cluster int, i int, j int, g double, s double, n bigint, q double, q2 double"
    )
    summed = cells.groupBy("cluster", "i", "j").agg(*[F.sum(c).alias(c) for c in ("g", "s", "n", "q", "q2")])
    totals = summed.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        ((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("s1"),
        ((F.sum(F.col("g") * F.col("g")) - F.sum("q2")) / 2).alias("s2"),
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean, square = F.col("s1") / pairs, F.col("s2") / pairs
    several = F.col("n") > 1
    return totals.select(
        "cluster",
        "n",
        F.when(several, mean).alias("mean_cosine"),
        F.when(several, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std_cosine"),
    )


def compare_clusterings(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Contingency of two labelings: rows per pair of labels and its share of the first label."""
    left = a.select(key, F.col("cluster").alias("cluster_a"))
    right = b.select(key, F.col("cluster").alias("cluster_b"))
    cells = left.join(right, key).groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("n"))
    totals = cells.groupBy("cluster_a").agg(F.sum("n").alias("n_a"))
    return cells.join(totals, "cluster_a").select(
        "cluster_a", "cluster_b", "n", (F.col("n") / F.col("n_a")).alias("share_a")
    )


def best_matches(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each label of `a`, the label of `b` it overlaps most, ties by number."""
    cells = compare_clusterings(a, b, key)
    return top_n_per_group(cells, ["cluster_a"], [F.desc("n"), F.col("cluster_b")], 1).drop("rank")


def purity(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of rows that lie in the best match of their label, in one row."""
    best = best_matches(a, b, key).withColumn("n_a", F.col("n") / F.col("share_a"))
    return best.agg((F.sum("n") / F.sum("n_a")).alias("purity"))


