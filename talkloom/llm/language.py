"""Language identification by nearest centroids of character n-grams.

A text becomes a vector of hashed n-gram counts, damped, weighted by inverse document frequency and of length one. Each
language has several centroids, found by clustering a bounded sample of its labelled texts; a text gets the language of
the centroid with the largest cosine. A text that is farther from its centroid than nearly all of the sample is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.tables import keyed, map_rows, release_memory
from talkloom.runtime import cut, lookup_join

# n-grams of one to GRAM letters; a run of other characters counts as one blank.
GRAM = 3
# Vector components that the n-grams are hashed to.
DIMENSIONS = 1 << 14
# Centroids of a language, and labelled texts they are fitted on, at most: those with the
# smallest hashes.
CENTROIDS, SAMPLE = 4, 1000
# Clustering steps; each moves the centroids to the means of their texts.
STEPS = 8
# A text is rejected below SLACK times the cosine that all but RARE of the language's sample reach. On the sf0.01 documents the
# shortest labelled texts, of a word or two, have cosines of 0.22 to 0.37, random letters, base64 and a sentence each of
# Finnish, Turkish and Polish at most 0.15.
RARE, SLACK = 0.01, 0.4
UNKNOWN = "und"

# Texts are counted together up to so many characters; a longer one is counted by itself.
CHUNK = 1 << 18
CHUNK_TEXTS = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one blank; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(letter, points, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of other characters
    keep[0] = True
    points = points[keep]
    return np.concatenate(([32], points, [32])).astype(np.uint32)


def gram_counts(texts: list[str | None], dimensions: int = DIMENSIONS, gram: int = GRAM) -> np.ndarray:
    """Counts of the hashed n-grams, a row per text."""
    parts = [_points(t or "") for t in texts]
    sizes = np.array([len(p) for p in parts])
    points = np.concatenate([*parts, np.zeros(gram, np.uint32)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    ends = np.cumsum(sizes)[owner] if len(owner) else owner
    counts = np.zeros(len(parts) * dimensions, np.int64)
    value, n = np.zeros(len(owner), np.uint64), len(owner)
    for length in range(1, gram + 1):
        value = (value * np.uint64(0x100000001B3)) ^ points[length - 1 : length - 1 + n]
        cell = ((value + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        fits = np.arange(n) + length <= ends if length > 1 else points[:n] != 32  # a blank alone says nothing
        place = owner * dimensions + (cell % np.uint64(dimensions)).astype(np.int64)
        counts += np.bincount(place[fits], minlength=len(counts))
    return counts.reshape(len(parts), dimensions)


@dataclass
class Centroids:
    languages: list[str]  # sorted
    idf: np.ndarray
    vectors: np.ndarray  # a row per centroid
    language: np.ndarray  # of each centroid
    least: np.ndarray  # cosine below which a text is rejected, that of the centroid's language

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return weighed(counts, self.idf)

    def nearest(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether it is rejected, of each text."""
        counts = gram_counts(texts, len(self.idf))
        empty = ~counts.any(axis=1)
        if not len(self.languages):
            return [(UNKNOWN, 0.0, True)] * len(texts)
        cosines = self.weigh(counts) @ self.vectors.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [
            (UNKNOWN, 0.0, True) if empty[t] else
            (self.languages[self.language[best[t]]], float(score[t]), bool(score[t] < self.least[best[t]]))
            for t in range(len(texts))
        ]


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequencies, rows of length one (or zero)."""
    vectors = (np.log1p(counts) * idf).astype(np.float32)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=vectors, where=lengths > 0)


def cluster(vectors: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """Centroids of length one, at most `k`: the means of equal parts along the direction in which the vectors vary most,
    then moved to the means of the vectors nearest to them."""
    mean = vectors.mean(axis=0)
    direction = vectors[(vectors @ mean).argmin()] - mean
    for _ in range(steps):
        along = vectors @ direction
        along -= along.mean()
        direction = along @ vectors  # centred vectors give the same, without a copy of all
        direction /= max(np.linalg.norm(direction), 1e-12)
    parts = np.array_split(np.argsort(vectors @ direction, kind="stable"), min(k, len(vectors)))
    centroids = _unit(np.array([vectors[part].mean(axis=0) for part in parts]))
    for _ in range(steps):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        centroids = _unit(sums[np.unique(own)])
    return centroids


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _grouped(rows: Iterable[tuple], text: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        n = len(row[text] or "")
        if held and (size + n > CHUNK or len(held) >= CHUNK_TEXTS):
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def fit(
    labelled: DataFrame,
    dimensions: int = DIMENSIONS,
    centroids: int = CENTROIDS,
    sample: int = SAMPLE,
    text: str = "text",
    lang: str = "lang",
) -> Centroids:
    """Centroids from the labelled texts.

    Document frequencies count all labelled texts. A language's centroids are fitted on the `sample` different texts with
    the smallest hashes, at most; the driver gets `dimensions` numbers for each centroid. Rows with a null text or language,
    or without letters, are left out; without any rows the result knows no language and all texts are rejected.
    """
    known = labelled.select(labelled[text].cast("string").alias("text"), labelled[lang].cast("string").alias("lang"))
    known = known.where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(rows: Iterable[tuple]) -> Iterator[tuple]:
        total, n = np.zeros(dimensions, np.int64), 0
        for held in _grouped(rows, 0):
            present = gram_counts([r[0] for r in held], dimensions) > 0
            total += present.sum(axis=0)
            n += int(present.any(axis=1).sum())
        yield -1, n
        yield from ((int(i), int(total[i])) for i in np.flatnonzero(total))

    found = map_rows(known.select("text"), frequencies, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = {r.cell: r.n for r in found.collect()}  # one row per dimension
    total = counts.pop(-1, 0)
    frequency = np.zeros(dimensions)
    frequency[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1

    # Hashes are spread evenly: twice the sample is expected below a language's limit, and cut to the sample exactly.
    share = F.least(F.lit(1.0), 2.0 * sample / F.col("n"))
    limits = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (2.0**64 * share - 2.0**63).alias("limit"))
    below = lookup_join(known, cut(limits, "language-limits"), "lang").where(F.xxhash64("text") <= F.col("limit"))
    below = below.dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"))
    chosen = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        vectors, n = np.zeros((len(group), dimensions), np.float32), 0
        for held in _grouped(zip(group["text"]), 0):
            part = weighed(gram_counts([r[0] for r in held], dimensions), idf)
            part = part[part.any(axis=1)]
            vectors[n : n + len(part)] = part
            n += len(part)
        vectors = vectors[:n]
        if not len(vectors):
            return pd.DataFrame(columns=["lang", "vector", "least"], dtype=object)
        found = cluster(vectors, centroids)
        least = SLACK * float(np.quantile((vectors @ found.T).max(axis=1), RARE))
        del vectors
        release_memory()
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "vector": [c.astype("<f4").tobytes() for c in found], "least": least}
        )

    fitted = chosen.select("lang", "text").groupBy("lang").applyInPandas(centre, "lang string, vector binary, least double")
    rows = sorted(fitted.collect(), key=lambda r: (r.lang, bytes(r.vector)))
    names = sorted({r.lang for r in rows})
    vectors = np.array([np.frombuffer(r.vector, "<f4") for r in rows], np.float32).reshape(len(rows), dimensions)
    return Centroids(
        names, idf, vectors, np.array([names.index(r.lang) for r in rows], np.int64), np.array([r.least for r in rows])
    )


def identify(docs: DataFrame, model: Centroids, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of each whole text; one row per document.

    Columns: doc_id, row_key (hash of doc_id and text), lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected.

    A text that is null, empty or without letters is `und` with score 0 and rejected; so is every text if the model knows
    no language. Any other text has a language that was learned, also if it is rejected as too far from the centroid. Of
    equally near centroids the one of the language that sorts first counts. Null ids and repeated rows are kept; an empty
    table gives no rows. Other columns are not read.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for held in _grouped(rows, 1):
            for row, found in zip(held, model.nearest([r[1] for r in held]), strict=True):
                yield row[0], row[2], *found

    texts = keyed(docs, doc_id, text).select("doc_id", F.col("text").cast("string"), "row_key")
    return map_rows(texts, run, "doc_id bigint, row_key bigint, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """True for a third of the documents, which are not learned from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
