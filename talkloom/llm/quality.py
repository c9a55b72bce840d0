"""Quality scores by logistic regression on hashed word n-grams.

A text's tokens are its words and its runs of punctuation; a token also has a shape (letters' case, digits, signs). n-grams of
tokens and of shapes are hashed to cells; a text is the damped counts of its cells, scaled to length one. Weights are learned
by follow-the-regularised-leader updates, one labelled text at a time: shards of the labelled texts are run through in
parallel from the same state, whose sums are averaged after every round. A score is the logistic function of a sparse
dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.segments import segments
from talkloom.llm.tables import keyed, map_rows
from talkloom.llm.words import BASE, INVERSE, chunks, mix, power
from talkloom.runtime import cut, scratch_path

# Cells that n-grams are hashed to; n-grams of one to WORDS tokens and of one to SHAPES shapes.
CELLS, WORDS, SHAPES = 1 << 18, 2, 3
# Labelled texts that are learned from, at most: those whose ids have the smallest hashes.
SAMPLE = 16_384
# Shards are run through in parallel, ROUNDS times.
SHARDS, ROUNDS = 4, 12
# Rate, its damping, and the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 1e-4
_VECTORS, _STATES = "order bigint, label double, cells binary, `values` binary", "shard int, z binary, n binary"
# Texts are hashed together up to so many bytes, in segments if one is longer.
CHUNK_BYTES = 1 << 18

_BREAK = re.compile(rb"[ \n\t]")
_VALUES = np.random.default_rng(20240311).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
# Kinds of bytes: blank, sign, lower case, upper case, digit, not ASCII.
_KINDS = np.ones(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[ord("a") : ord("z") + 1] = 2
_KINDS[ord("A") : ord("Z") + 1] = 3
_KINDS[ord("0") : ord("9") + 1] = 4
_KINDS[128:] = 5


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, hash and shape of each token."""
    kind = _KINDS[data]
    group = np.minimum(kind, 2)  # blank, sign, part of a word
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = group[1:] != group[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = group[starts] > 0
    starts, ends = starts[real], ends[real]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power(BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * power(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    # Shape of a word: the kinds it holds, and whether it is of one byte; of signs: the signs themselves.
    held = np.zeros((len(starts), 6), bool)
    for k in range(2, 6):
        seen = np.concatenate(([0], np.cumsum(kind == k)))
        held[:, k] = seen[ends] > seen[starts]
    first_upper = kind[starts] == 3
    shape = held @ (1 << np.arange(6)) + 64 * first_upper + 128 * (ends - starts == 1)
    return starts, hashes, np.where(group[starts] == 1, hashes, mix(shape.astype(np.uint64) + np.uint64(1)))


def _grams(values: np.ndarray, owner: np.ndarray, size: int, kind: int, cells: int) -> Iterator[np.ndarray]:
    """Owner times `cells` plus cell of each n-gram of up to `size` values of one owner."""
    hashed = np.zeros(len(values), np.uint64)
    for n in range(1, size + 1):
        if len(values) < n:
            return
        hashed = mix(hashed[: len(values) - n + 1] + values[n - 1 :] + np.uint64(8 * n + kind))
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        cell = (hashed >> np.uint64(40)) % np.uint64(cells)
        yield (owner[: len(cell)] * cells + cell.astype(np.int64))[whole]


def cell_counts(texts: list[bytes], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the texts, each text's as text number times `cells` plus cell, and how often each occurs."""
    joined = b"\n".join(texts)
    starts, hashes, shapes = _tokens(np.frombuffer(joined, np.uint8)) if joined else ([], *np.zeros((2, 0), np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(begins, starts, side="right") - 1
    found = [*_grams(hashes, owner, WORDS, 0, cells), *_grams(shapes, owner, SHAPES, 1, cells)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)


def vectors(texts: list[bytes | None], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, cell and value of all entries; a text's values have length one. n-grams of a text longer than a chunk
    end where its segments do."""
    if len(texts) == 1 and len(texts[0] or b"") > CHUNK_BYTES:
        total = np.zeros(cells, np.int64)
        for part in segments(texts[0], _BREAK, CHUNK_BYTES):
            place, n = cell_counts([part], cells)
            total[place] += n
        place = np.flatnonzero(total)
        counts = total[place]
    else:
        place, counts = cell_counts([t or b"" for t in texts], cells)
    text, cell = place // cells, place % cells
    value = 1 + np.log(counts)
    lengths = np.sqrt(np.bincount(text, value * value, len(texts)))
    return text, cell, value / lengths[text]


@dataclass
class Leader:
    """State of the updates, a number per cell and one for the intercept: sums of gradients and of their squares."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls, cells: int = CELLS) -> Leader:
        return cls(np.zeros(cells + 1), np.zeros(cells + 1))

    @classmethod
    def mean(cls, states: list[tuple[bytes, bytes]], cells: int) -> Leader:
        if not states:
            return cls.new(cells)
        return cls(*(np.mean([np.frombuffer(x, "<f8") for x in held], axis=0) for held in zip(*states, strict=True)))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = z - np.sign(z) * L1
        return np.where(np.abs(z) <= L1, 0.0, -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One update with a text's cells, their values and the label's mean."""
        w = self.weights(at)
        gradient = (logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, cells: int) -> str:
    """Writes the different labelled texts as sparse vectors, with the mean of their labels, by shard; the folder."""
    known = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("binary").alias("text"))
    joined = known.where("text IS NOT NULL").join(F.broadcast(labels), "doc_id").select(
        F.xxhash64("text").alias("order"), "label", "text"
    )

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for held in chunks(rows, limit=CHUNK_BYTES):
            number, cell, value = vectors([r[2] for r in held], cells)
            ends = np.searchsorted(number, np.arange(len(held) + 1))
            for row, a, b in zip(held, ends[:-1], ends[1:], strict=True):
                yield row[0], row[1], cell[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()

    found = map_rows(joined, run, _VECTORS)
    merged = found.groupBy("order").agg(
        F.avg("label").alias("label"), F.first("cells").alias("cells"), F.first("values").alias("values")
    )
    path = scratch_path(docs.sparkSession, "labelled-vectors")
    sharded = merged.withColumn("shard", F.pmod("order", F.lit(SHARDS)).cast("int")).repartition(SHARDS, "shard")
    sharded.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def _shards(spark: SparkSession, path: str, numbers: list[int], states: DataFrame | None) -> DataFrame:
    """Each shard in one task: the states that the round before left, and then the labelled vectors in the order of their
    hashes. They are read anew every round, without a shuffle."""
    shards = []
    for n in numbers:
        rows = spark.read.schema(_VECTORS).parquet(f"{path}/shard={n}").withColumn("is_state", F.lit(False))
        if states is not None:
            rows = rows.unionByName(states.select(
                F.col("shard").cast("bigint").alias("order"), F.lit(None).cast("double").alias("label"),
                F.col("z").alias("cells"), F.col("n").alias("values"), F.lit(True).alias("is_state"),
            ))
        ordered = rows.coalesce(1).sortWithinPartitions(F.desc("is_state"), "order")
        shards.append(ordered.select(F.lit(n).alias("shard"), "is_state", "label", "cells", "values"))
    return reduce(DataFrame.unionByName, shards)


def sampled(labels: DataFrame, doc_id: str, label: str, sample: int) -> DataFrame:
    """Label of each labelled document: of all if there are at most `sample`, else of those with the smallest hashes."""
    mean = labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull()).groupBy(
        labels[doc_id].cast("bigint").alias("doc_id")
    ).agg(F.avg(labels[label].cast("double")).alias("label"))
    mean = cut(mean.withColumn("order", F.xxhash64("doc_id")), "label-means")
    n = mean.count()
    if n > sample:  # hashes are spread evenly, so that about twice the sample is sorted
        mean = mean.where(F.col("order") <= 2.0**64 * min(1.0, 2 * sample / n) - 2.0**63)
        mean = mean.orderBy("order", "doc_id").limit(sample)
    return cut(mean.select("doc_id", "label"), "label-sample")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    cells: int = CELLS,
) -> np.ndarray:
    """Weights of the cells, the intercept last, from the documents that `labels` marks 0 or 1.

    At most `sample` labelled documents are learned from. Equal texts count once, with the mean of their labels, as do
    several labels of one id; rows with a null id, label or text are left out. Without any labelled text all weights are 0,
    and all scores one half. The states of SHARDS shards, two numbers per cell, go from round to round by files; the driver
    gets the weights at the end only.
    """
    chosen = sampled(labels, doc_id, label, sample)
    spark, path = docs.sparkSession, _features(docs, chosen, doc_id, text, cells)
    found = spark.read.schema(f"{_VECTORS}, shard int").parquet(path).select("shard").distinct().collect()
    numbers = sorted(r["shard"] for r in found)

    def run(part: Iterable[tuple]) -> Iterator[tuple]:
        for shard, rows in groupby(part, itemgetter(0)):
            before, own = [], None
            for _, is_state, mean, at, values in rows:
                if is_state:
                    before.append((at, values))
                    continue
                own = own or Leader.mean(before, cells)
                at = np.append(np.frombuffer(at, "<i4"), cells)
                own.learn(at, np.append(np.frombuffer(values, "<f4").astype(float), 1.0), mean)
            yield shard, own.z.astype("<f8").tobytes(), own.n.astype("<f8").tobytes()

    def end(part: Iterable[tuple]) -> Iterator[tuple]:
        yield (Leader.mean([row[1:] for row in part], cells).weights().astype("<f8").tobytes(),)

    states = None
    for _ in range(rounds if numbers else 0):
        left = scratch_path(spark, "quality-states")
        learned = map_rows(_shards(spark, path, numbers, states), run, _STATES)
        learned.write.option("compression", "zstd").parquet(left)
        states = spark.read.schema(_STATES).parquet(left)
    if states is None:
        return Leader.new(cells).weights()
    last = map_rows(states.coalesce(1).sortWithinPartitions("shard"), end, "weights binary")
    return np.frombuffer(last.first()["weights"], "<f8")


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of each whole text, 0 to 1, higher where label 1 is likelier; one row per document: doc_id, row_key, score.

    A null, empty or blank text has the score of the intercept. Null ids and repeated rows are kept; an empty table gives no
    rows. Other columns are not read.
    """
    cells = len(weights) - 1
    packed = weights.astype(np.float32)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for held in chunks(rows, text=1, limit=CHUNK_BYTES):
            number, cell, value = vectors([r[1] for r in held], cells)
            dots = np.bincount(number, value * packed[cell], len(held))
            for row, s in zip(held, logistic(dots + packed[-1]).tolist(), strict=True):
                yield row[0], row[2], s

    return map_rows(keyed(docs, doc_id, text), run, "doc_id bigint, row_key bigint, score double")


def held_out(doc_id: str = "doc_id"):
    """True for a fifth of the documents, which are not learned from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
