"""Mini-batch k-means: small seeded batches, one job per batch for any number of models.

Rows are laid out once by a seeded hash of their key; a batch is the next stretch of that order, found by folder and row
group. Small batches are not worth a job each: one task takes the steps on a bounded number of them, in their order. A step moves each centre towards the mean of its rows of the batch, by the share that those rows have in all rows the
centre has seen. Models for several k take the same steps in the same jobs, so a sweep costs about as much as its largest k.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.vectors import as_doubles
from talkloom.runtime import scratch_path

# Folders that the rows are laid out in, at most; a batch reads one or two of them.
MAX_CHUNKS = 1024
# Rows that seeds are drawn from, in batches, and doubles of distances that a task holds.
SEED_BATCHES, STEP_CELLS = 3, 4_000_000
# Rows, about, that one task steps through, and the fewest batches of them that are worth it; larger batches are spread.
STRETCH_ROWS, STRETCH_BATCHES = 1 << 15, 4
# A centre is starved below this share of the rows that the fullest has seen.
STARVED = 0.01
# A model ends after so many steps without a lower running mean of the inertia per row, by this share at least.
PATIENCE, GAIN = 10, 1e-4


@dataclass
class Centres:
    """One model: its centres, and how many rows each has seen."""

    points: np.ndarray
    seen: np.ndarray
    mean: float | None = None  # running mean of the inertia per row
    lowest: float = np.inf
    idle: int = field(default=0)

    @classmethod
    def at(cls, points) -> Centres:
        points = np.array(points, dtype=float)
        return cls(points, np.zeros(len(points)))

    def move(self, sums: np.ndarray, n: np.ndarray) -> Centres:
        """The centres after a batch, of which cluster i has n[i] rows that add up to sums[i]."""
        seen = self.seen + n
        share = np.divide(1.0, seen, out=np.zeros_like(seen), where=n > 0)
        return Centres(self.points + (sums - n[:, None] * self.points) * share[:, None], seen, self.mean, self.lowest, self.idle)

    def reseed(self, rows: np.ndarray, share: float = STARVED) -> None:
        """Put starved centres on rows of the batch, and count them as the least of the others."""
        starved = np.flatnonzero(self.seen < share * self.seen.max())[: len(rows)]
        if len(starved) and len(starved) < len(self.seen):
            others = np.delete(self.seen, starved)
            self.points[starved], self.seen[starved] = rows[: len(starved)], others.min()

    def watch(self, inertia: float, weight: float) -> None:
        self.mean = inertia if self.mean is None else self.mean + weight * (inertia - self.mean)
        if self.mean < self.lowest * (1 - GAIN):
            self.lowest, self.idle = self.mean, 0
        else:
            self.idle += 1


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, ties to the lower number, and the squared distance."""
    label, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    squares = (centres * centres).sum(axis=1)
    step = max(1, STEP_CELLS // len(centres))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        label[at : at + step] = (squares - 2 * part @ centres.T).argmin(axis=1)
        distance[at : at + step] = ((part - centres[label[at : at + step]]) ** 2).sum(axis=1)
    return label, distance


def _sums(batch: DataFrame, vec: str, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per model: sum and number of each cluster's rows, and inertia. A task sends a row per cluster."""

    def run(batches):
        import pandas as pd

        total = [(np.zeros_like(m), np.zeros(len(m)), np.zeros(len(m))) for m in models]
        for part in batches:
            if len(part):
                x = np.array(part[vec].tolist(), dtype=float)
                for m, (sums, n, inertia) in zip(models, total, strict=True):
                    label, distance = nearest(x, m)
                    np.add.at(sums, label, x)
                    n += np.bincount(label, minlength=len(m))
                    inertia += np.bincount(label, distance, len(m))
        rows = [
            (i, c, float(n[c]), float(inertia[c]), sums[c]) for i, (sums, n, inertia) in enumerate(total) for c in np.flatnonzero(n)
        ]
        if rows:
            yield pd.DataFrame(rows, columns=["model", "cluster", "n", "inertia", "total"])

    found = batch.select(as_doubles(vec).alias(vec)).mapInPandas(
        run, "model int, cluster int, n double, inertia double, total array<double>"
    )
    result = [[np.zeros_like(m), np.zeros(len(m)), 0.0] for m in models]
    for row in sorted(found.collect(), key=lambda r: (r["model"], r["cluster"], r["inertia"])):
        one = result[row["model"]]
        one[0][row["cluster"]] += row["total"]
        one[1][row["cluster"]] += row["n"]
        one[2] += row["inertia"]
    return [tuple(r) for r in result]


def minibatch_update(batch: DataFrame, models: list[Centres], vec: str) -> list[Centres]:
    """The models after one step on the rows of `batch`; in each, starved centres stay where they are."""
    return [m.move(sums, n) for m, (sums, n, _) in zip(models, _sums(batch, vec, [m.points for m in models]), strict=True)]


class Batches:
    """Rows `(key, vec)` laid out by a seeded hash of the key, and the batches in that order."""

    def __init__(self, points: DataFrame, key: str, vec: str, batch_size: int, seed: int):
        self.spark, self.vec, self.batch_size = points.sparkSession, vec, batch_size
        rows = points.select(F.col(key), as_doubles(vec).alias(vec), F.xxhash64(F.lit(seed), F.col(key)).alias("_place"))
        self.n = rows.count()
        self.n_batches = max(1, -(-self.n // batch_size))
        self.chunks = min(MAX_CHUNKS, self.n_batches)
        self.path = scratch_path(self.spark, "batches")
        share = (F.col("_place").cast("double") + 2.0**63) / 2.0**64
        chunk = F.least(F.floor(share * self.chunks), F.lit(self.chunks - 1)).cast("int")
        laid = rows.withColumn("_chunk", chunk)
        if self.chunks > 1:
            laid = laid.repartitionByRange("_place").sortWithinPartitions("_place")
        self.schema = T.StructType([*laid.drop("_chunk").schema.fields, T.StructField("_chunk", T.IntegerType())])
        laid.write.partitionBy("_chunk").parquet(self.path)
        self.laid = self.spark.read.schema(self.schema).parquet(self.path)  # once, as it lists up to MAX_CHUNKS folders

    def all(self) -> DataFrame:
        return self.laid

    def limits(self, number: int) -> tuple[int, int]:
        """First place of a batch and the first behind it."""
        return tuple(-(1 << 63) + (1 << 64) * i // self.n_batches for i in (number, number + 1))

    def get(self, number: int, n: int = 1) -> DataFrame:
        """A batch, or `n` successive ones, which may not begin anew."""
        number %= self.n_batches
        low, high = self.limits(number)[0], self.limits(number + n - 1)[1]
        first, last = (min(self.chunks - 1, (p + (1 << 63)) * self.chunks >> 64) for p in (low, high - 1))
        # A place is put in its folder by a double, which may round it over the folder's limit.
        near = F.col("_chunk").between(max(0, first - 1), last + 1)
        return self.all().where(near & (F.col("_place") >= low) & (F.col("_place") <= high - 1))

    def first_rows(self, number: int, n: int) -> np.ndarray:
        """The batch's first rows, to put starved centres on."""
        rows = self.get(number).orderBy("_place").select(self.vec).limit(n).collect()
        return np.array([r[0] for r in rows], dtype=float)

    def stretch(self, number: int, most: int) -> int:
        """How many batches from a number on one task may step through, 0 if they are too large for that."""
        n = STRETCH_ROWS // self.batch_size
        return 0 if n < STRETCH_BATCHES else min(n, most, self.n_batches - number % self.n_batches)

    def steps(
        self, number: int, n: int, models: dict[int, Centres], weight: float, patience: int, starved_below: float
    ) -> tuple[dict[int, Centres], int]:
        """The models after their steps on `n` successive batches, taken by one task, and the steps until all had ended."""
        vec = self.vec
        ends = [self.limits((number + i) % self.n_batches)[1] - 1 for i in range(n)]

        def run(batches):
            import pandas as pd

            place, x = np.zeros(0, np.int64), np.zeros((0, 1))
            parts = [(b["_place"].to_numpy(), np.array(b[vec].tolist(), dtype=float)) for b in batches if len(b)]
            if parts:
                place, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            moved, running, start, taken = dict(models), list(models), 0, 0
            for stop in np.searchsorted(place, np.array(ends, np.int64), side="right"):
                rows, start = x[start:stop], stop
                for k in running:
                    if len(rows):
                        label, distance = nearest(rows, moved[k].points)
                        sums = np.zeros_like(moved[k].points)
                        np.add.at(sums, label, rows)
                        moved[k] = moved[k].move(sums, np.bincount(label, minlength=k).astype(float))
                        moved[k].watch(distance.sum() / len(rows), weight)
                    moved[k].reseed(rows[:k], starved_below)
                running = [k for k in running if moved[k].idle < patience]
                taken += 1
                if not running:
                    break
            found = [(k, list(m.points), m.seen, m.mean, m.lowest, m.idle, taken) for k, m in moved.items()]
            yield pd.DataFrame(found, columns=["k", "points", "seen", "mean", "lowest", "idle", "taken"])

        ordered = self.get(number, n).coalesce(1).sortWithinPartitions("_place").select("_place", vec)
        found = ordered.mapInPandas(
            run, "k int, points array<array<double>>, seen array<double>, mean double, lowest double, idle int, taken int"
        ).collect()
        after = {r["k"]: Centres(np.array(r["points"]), np.array(r["seen"]), r["mean"], r["lowest"], r["idle"]) for r in found}
        return after, found[0]["taken"]

    def seeds(self, k: int, n_init: int, seed: int) -> np.ndarray:
        """k-means++ seeds from the first SEED_BATCHES batches, the best of `n_init` draws; their first j are seeds for j.

        One task draws them, from a number of rows that doesn't grow with the table.
        """
        vec, sample = self.vec, self.get(0)
        for number in range(1, min(SEED_BATCHES, self.n_batches)):
            sample = sample.unionByName(self.get(number))

        def draw(batches):
            import pandas as pd

            parts = [np.array(b[vec].tolist(), dtype=float) for b in batches if len(b)]
            if not parts:
                return
            x, best = np.concatenate(parts), None
            for attempt in range(n_init):
                rng = np.random.default_rng(seed + attempt)
                chosen = [int(rng.integers(len(x)))]
                distance = ((x - x[chosen[0]]) ** 2).sum(axis=1)
                while len(chosen) < k:
                    ends = np.cumsum(distance)
                    at = int(np.searchsorted(ends, rng.random() * ends[-1], side="right")) if ends[-1] > 0 else len(chosen)
                    chosen.append(min(at, len(x) - 1))
                    distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
                if best is None or distance.sum() < best[0]:
                    best = distance.sum(), chosen
            yield pd.DataFrame({"place": range(k), "seed": list(x[best[1]])})

        ordered = sample.coalesce(1).sortWithinPartitions("_place").select(vec)
        found = ordered.mapInPandas(draw, "place int, seed array<double>").collect()
        return np.array([r["seed"] for r in sorted(found, key=lambda r: r["place"])], dtype=float)


@dataclass
class MiniBatches:
    """Fitted models by k, the inertia of each over all rows, and the steps that were taken."""

    batches: Batches
    key: str
    models: dict[int, Centres]
    inertia: dict[int, float]
    steps: int

    def labels(self, k: int) -> DataFrame:
        """`(key, cluster)` of all rows by the model for `k`."""
        centres, key, vec = self.models[k].points, self.key, self.batches.vec
        rows = self.batches.all().select(key, vec)

        def assign(parts):
            import pandas as pd

            for part in parts:
                if len(part):
                    label, _ = nearest(np.array(part[vec].tolist(), dtype=float), centres)
                    yield pd.DataFrame({key: part[key], "cluster": label})

        return rows.mapInPandas(assign, f"`{key}` {rows.schema[key].dataType.simpleString()}, cluster int")

    def table(self) -> DataFrame:
        rows = [(int(k), float(v)) for k, v in sorted(self.inertia.items())]
        return self.batches.spark.createDataFrame(rows, "k bigint, inertia double")


def minibatch_kmeans(
    points: DataFrame,
    ks: int | Iterable[int],
    key: str = "doc_id",
    vec: str = "vec",
    batch_size: int = 10_000,
    max_iter: int = 100,
    n_init: int = 10,
    seed: int = 42,
    seeds: np.ndarray | None = None,
    patience: int = PATIENCE,
    starved_below: float = STARVED,
) -> MiniBatches:
    """Mini-batch k-means of `(key, vec)` for one k or several, with at most `max_iter` rounds through the rows.

    Given `seeds`, the first k of them start the model for k; else seeds are drawn. A model ends when the running mean of
    the inertia has not fallen for `patience` steps. Centres that have seen less than a share of `starved_below` of the
    fullest one's rows are put on rows of the batch. Vectors must not be null.
    The driver holds centres only, k times dimensions for each k, and gets as many from each task of a step.
    """
    ks = [ks] if isinstance(ks, int) else sorted(set(ks))
    if not ks or min(ks) < 1 or batch_size < 1:
        raise ValueError("every k and the batch size must be at least 1")
    batches = Batches(points, key, vec, batch_size, seed)
    if batches.n < max(ks):
        raise ValueError(f"{batches.n} rows can't have {max(ks)} clusters")
    if seeds is None:
        seeds = batches.seeds(max(ks), n_init, seed)
    if len(seeds) < max(ks):
        raise ValueError("fewer seeds than clusters")
    models = {k: Centres.at(seeds[:k]) for k in ks}
    weight = min(1.0, 2 * batch_size / (batches.n + 1))
    running, step = list(ks), 0
    while running and step < max_iter * batches.n_batches:
        stretch = batches.stretch(step, max_iter * batches.n_batches - step)
        if stretch:
            after, taken = batches.steps(step, stretch, {k: models[k] for k in running}, weight, patience, starved_below)
            models |= after
            running = [k for k in running if models[k].idle < patience]
            step += taken
            continue
        found = _sums(batches.get(step), vec, [models[k].points for k in running])
        for k, (sums, n, inertia) in zip(running, found, strict=True):
            if n.sum():
                models[k] = models[k].move(sums, n)
                models[k].watch(inertia / n.sum(), weight)
        starved = [k for k in running if (models[k].seen < starved_below * models[k].seen.max()).any()]
        if starved:
            rows = batches.first_rows(step, max(starved))
            for k in starved:
                models[k].reseed(rows, starved_below)
        running = [k for k in running if models[k].idle < patience]
        step += 1
    whole = _sums(batches.all(), vec, [models[k].points for k in ks])
    return MiniBatches(batches, key, models, {k: w[2] for k, w in zip(ks, whole, strict=True)}, step)


def minibatch_kmeans_sweep(points: DataFrame, ks: Iterable[int], key: str = "doc_id", vec: str = "vec", **how) -> DataFrame:
    """`(k, inertia)` of mini-batch k-means for each k, all in the same jobs."""
    return minibatch_kmeans(points, ks, key, vec, **how).table()
