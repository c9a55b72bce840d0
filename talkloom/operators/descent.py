"""Approximate nearest neighbours by descent: neighbours of neighbours are likely neighbours.

Every point begins with its nearest points in some cells of random projections. In each round the points that share a
neighbour, in either direction, are compared with each other, and lists keep what is nearer. A point that very many lists
hold is met in parts of bounded size, dealt anew every round, so no meeting is left out and none grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.blocks import BLOCK_ROWS, pack_blocks
from talkloom.operators.knn import metric_space, spread_to_copies
from talkloom.operators.sampling import sample_exact
from talkloom.runtime import cut, lookup_join, top_n_per_group

# Projections that lists begin with, points that meet at once, and rounds at most.
STARTS, MEETING, ROUNDS = 3, 64, 12
# The descent ends when a round changes a smaller share of all list entries.
CHANGED = 0.001
# Points whose exact neighbours the recall is measured on.
RECALL_POINTS = 256


@dataclass
class Neighbours:
    """Lists `(key, neighbour, rank, distance)`, the recall measured on a sample of points, and the rounds that were run."""

    lists: DataFrame
    recall: float
    rounds: int


def _nearest_in_groups(groups: DataFrame, kind: str, k: int) -> DataFrame:
    """The k nearest of each member among the others of its group, as far as they are nearer than the member's reach and one
    of both is new: `(key, neighbour, distance)`. Groups are `(keys, vecs, reaches, news)`."""

    def compare(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            found = []
            for keys, vecs, reaches, news in batch.itertuples(index=False):
                x, keys, new = np.array(vecs.tolist()), np.asarray(keys), np.asarray(news)
                squares = (x * x).sum(axis=1)
                step = max(1, 4_000_000 // len(x))
                for start in range(0, len(x), step):
                    at = np.arange(start, min(start + step, len(x)))
                    d = np.maximum(squares[at, None] + squares[None] - 2 * x[at] @ x.T, 0.0)
                    d[np.arange(len(at)), at] = np.inf
                    d[~(new[at, None] | new[None])] = np.inf
                    limit = np.asarray(reaches)[at] ** 2 + 1e-9
                    if len(x) > k:
                        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                    distance = np.sqrt(((x[at[i]] - x[j]) ** 2).sum(axis=1))
                    found.append(pd.DataFrame({"key": keys[at[i]], "neighbour": keys[j], "distance": distance}))
            if found:
                yield pd.concat(found)

    return groups.select("keys", "vecs", "reaches", "news").mapInPandas(
        compare, f"key {kind}, neighbour {kind}, distance double"
    )


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest different neighbours of each key; `new` where no older list held them."""
    merged = candidates.groupBy("key", "neighbour").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    return cut(top_n_per_group(merged, ["key"], [F.col("distance"), F.col("neighbour")], k), "descent-lists")


def _start(rows: DataFrame, n: int, k: int, seed: int, kind: str) -> DataFrame:
    """Lists from the points that share a cell of random hyperplanes, for several sets of planes."""
    bits = max(0, int(np.ceil(np.log2(max(n / BLOCK_ROWS, 1)))))
    dims = len(rows.first()["vec"])
    found = None
    for start in range(STARTS):
        rng = np.random.default_rng(seed + start)
        planes = rng.normal(size=(max(bits, 1), dims))
        middle = np.median(np.array([r["vec"] for r in sample_exact(rows, "key", size=min(n, 1000), seed=seed).collect()]) @ planes.T, axis=0)

        def cells(batches, planes=planes, middle=middle):
            import numpy as np

            for batch in batches:
                if len(batch):
                    side = np.array(batch["vec"].tolist()) @ planes.T > middle
                    yield batch.assign(cell=side[:, :bits] @ (1 << np.arange(bits)) if bits else 0)

        celled = rows.mapInPandas(cells, f"key {kind}, vec array<double>, cell bigint")
        blocks = pack_blocks(celled, "key", ["vec"], "cell").select(
            "keys", "vecs",
            F.transform("keys", lambda _: F.lit(float("inf"))).alias("reaches"), F.transform("keys", lambda _: F.lit(True)).alias("news"),
        )
        own = _nearest_in_groups(blocks, kind, k)
        found = own if found is None else found.unionByName(own)
    return _best(found.withColumn("new", F.lit(1)), k)


def _meetings(lists: DataFrame, rows: DataFrame, k: int, number: int) -> DataFrame:
    """Groups of points that share a neighbour in either direction, at most about MEETING of them, with their vectors."""
    there = lists.select(F.col("key").alias("at"), F.col("neighbour").alias("key"), "new")
    back = lists.select(F.col("neighbour").alias("at"), "key", "new")
    members = there.unionByName(back).groupBy("at", "key").agg(F.max("new").alias("new"))
    held = lists.groupBy(F.col("neighbour").alias("at")).agg(F.count("*").alias("_held"))
    hubs = cut(held.where(F.col("_held") + k > MEETING), "descent-hubs")
    parts = F.coalesce(F.ceil((F.col("_held") + k) / MEETING), F.lit(1))
    dealt = lookup_join(members, hubs, "at", "left").select(
        "at", F.pmod(F.xxhash64(F.lit(number), "key"), parts).alias("part"), "key", "new"
    )
    reach = lists.groupBy("key").agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    points = cut(rows.join(reach, "key", "left").na.fill(float("inf"), ["reach"]), "descent-points")
    # Not a lookup: vectors would be sent by way of the driver in every round.
    met = dealt.join(points.hint("merge"), "key").groupBy("at", "part").agg(
        F.collect_list(F.struct("key", "vec", "reach", (F.col("new") > 0).alias("new"))).alias("m"), F.max("new").alias("any")
    )
    return met.where((F.col("any") > 0) & (F.size("m") > 1)).select(
        F.col("m.key").alias("keys"), F.col("m.vec").alias("vecs"), F.col("m.reach").alias("reaches"), F.col("m.new").alias("news")
    )


def measured_recall(rows: DataFrame, lists: DataFrame, k: int, sample: int = RECALL_POINTS, seed: int = 42) -> float:
    """Share of the sampled points' entries that are as near as the exact k-th neighbour; every point is compared with the
    sample, in blocks."""
    chosen = sample_exact(rows, "key", size=min(sample, rows.count()), seed=seed).collect()
    kind = rows.schema["key"].dataType.simpleString()
    keys, x = np.array([r["key"] for r in chosen]), np.array([r["vec"] for r in chosen])

    def compare(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            if not len(batch):
                continue
            y, other = np.array(batch["vec"].tolist()), batch["key"].to_numpy()
            for i in range(len(x)):
                d = np.sqrt(((y - x[i]) ** 2).sum(axis=1))
                d[other == keys[i]] = np.inf
                near = np.argsort(d, kind="stable")[:k]
                near = near[np.isfinite(d[near])]
                yield pd.DataFrame({"key": keys[i], "distance": d[near]})

    exact = top_n_per_group(rows.mapInPandas(compare, f"key {kind}, distance double"), ["key"], [F.col("distance")], k)
    limits = exact.groupBy("key").agg(F.max("distance").alias("limit"), F.count("*").alias("n"))
    reached = lists.join(F.broadcast(limits), "key").where(F.col("distance") <= F.col("limit") * (1 + 1e-9) + 1e-12)
    total = limits.agg(F.sum("n")).first()[0] or 0
    return 1.0 if not total else reached.count() / total


def approximate_knn(
    points: DataFrame, k: int, key: str, vec: str, metric: str = "cosine", seed: int = 42, rounds: int = ROUNDS
) -> Neighbours:
    """About the k nearest other points of each point, where exact search would compare nearly all pairs.

    Equal vectors take part once, and their copies are put in afterwards as in `knn_graph`. Distances are exact, ties go to
    the smaller key. Recall is measured among the different vectors, on RECALL_POINTS of them.
    """
    rows = cut(metric_space(points, key, vec, metric), "descent-rows")
    kind = rows.schema["key"].dataType.simpleString()
    groups = cut(rows.groupBy("vec").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "descent-groups")
    distinct, total = groups.agg(F.count("*"), F.sum("n")).first()
    if not distinct:
        empty = points.sparkSession.createDataFrame([], f"`{key}` {kind}, neighbour {kind}, rank int, distance double")
        return Neighbours(empty, 1.0, 0)
    single = cut(groups.select(F.col("rep").alias("key"), "vec"), "descent-distinct")
    near = min(k, max(distinct - 1, 1))
    lists, number = _start(single, distinct, near, seed, kind), 0
    while number < rounds:
        candidates = _nearest_in_groups(_meetings(lists, single, near, number), kind, near)
        older = lists.select("key", "neighbour", "distance", F.lit(0).alias("new"))
        lists, number = _best(older.unionByName(candidates.withColumn("new", F.lit(1))), near), number + 1
        if lists.where("new = 1").count() <= CHANGED * distinct * near:
            break
    recall = measured_recall(single, lists, near, seed=seed)
    lists = lists.select("key", "neighbour", "rank", "distance")
    result = lists if total == distinct else spread_to_copies(rows, groups, lists, k)
    if metric == "cosine":
        result = result.withColumn("distance", F.col("distance") * F.col("distance") / 2)
    return Neighbours(result.select(F.col("key").alias(key), "neighbour", "rank", "distance"), recall, number)
