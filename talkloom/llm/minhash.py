"""Near-duplicates by circulant MinHash.

A document is the set of hashes of its SHINGLE-word shingles. Two permutations make all signature coordinates: the first
one mixes the shingle's hash, the second one, of 32-bit numbers, is applied after a circular shift by the coordinate's
number. Equal sets form one class, and only classes go on. Classes that share a band of coordinates are candidates; their
connected components, the clusters, hold every link with the error probability of the banding (below 1e-6 at the
threshold). Inside the clusters all links are confirmed on full sets, block by block; pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.graph import connected_components
from talkloom.llm.tables import keyed, map_rows
from talkloom.llm.words import SPACED, chunks, mix, windows, words
from talkloom.runtime import cut, lookup_join

SHINGLE = 5
# Links have 100 * common >= PERCENT * united shingles.
PERCENT = 85
# A pair at the threshold is missed with probability (1 - 0.85 ** ROWS) ** BANDS = 3e-7.
BANDS, ROWS = 32, 6
# Shingle sets that are compared together: their bytes, and how many, since the work is quadratic in their number.
BLOCK_BYTES, BLOCK_SETS = 1 << 20, 1024


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles, of all words together if there are fewer."""
    return np.unique(windows(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    first = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 1024):
        np.minimum(least, _second(first[at : at + 1024] + shift).min(axis=1), out=least)
    return least


def _bands(least: np.ndarray, bands: int, rows: int) -> list[int]:
    """A hash of each band's coordinates and its number."""
    values = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for column in least.reshape(bands, rows).T:
        values = mix(values ^ column)
    return values.view(np.int64).tolist()


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, class (a hash of the set) and bands of each document; the last two are null for a
    document without words."""

    def run(rows_: Iterable[tuple]) -> Iterator[tuple]:
        for held in chunks(rows_, text=1):
            found = words([r[1] for r in held], SPACED, lower=True)
            for t, (key, _, row_key) in enumerate(held):
                own = shingle_set(found.hashes[found.of(t)])
                if len(own):
                    yield key, row_key, len(own), _class(own), _bands(signature(own, bands * rows), bands, rows)
                else:
                    yield key, row_key, 0, None, None

    schema = "doc_id bigint, row_key bigint, n_shingles bigint, class bigint, bands array<bigint>"
    return map_rows(keyed(docs, doc_id, text), run, schema)


def _class(shingles: np.ndarray) -> int:
    total = np.uint64(len(shingles)) + mix(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(mix(np.array([total]))[0].view(np.int64))


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Shingle sets of the documents in `wanted` (row_key, class, cluster, shared), each class once."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for held in chunks(rows, text=0):
            found = words([r[0] for r in held], SPACED, lower=True)
            for t, row in enumerate(held):
                yield *row[1:], shingle_set(found.hashes[found.of(t)]).tobytes()

    chosen = lookup_join(keyed(docs, doc_id, text), wanted, "row_key", hot=False).select(
        "text", "class", "cluster", "shared"
    )
    return map_rows(chosen, run, "class bigint, cluster bigint, shared bigint, shingles binary").dropDuplicates(["class"])


def _links(names: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Edges that connect the same sets as all links do: fewer than there are sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.argsort(shingle, kind="stable")
    postings, first = owner[by], np.concatenate(([0], np.cumsum(counts)))
    root = np.arange(len(sets))
    ends = np.cumsum(sizes)
    for i in range(len(sets) - 1):
        own = shingle[ends[i] - sizes[i] : ends[i]]
        own = own[counts[own] > 1]
        lengths = counts[own]
        at = np.repeat(first[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(postings[at], minlength=len(sets))
        linked = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
        linked = linked[root[linked] != root[i]]
        if len(linked):
            joined = np.isin(root, root[linked])
            yield from zip(names[[i] * len(linked)].tolist(), names[linked].tolist(), strict=True)
            root[joined] = root[i]


def _compare(sets: DataFrame, percent: int) -> DataFrame:
    """Links inside each part of a cluster (columns cluster, part, class, shingles); a part is two blocks at most."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for _, part in groupby(rows, key=lambda r: r[:2]):
            names, sets_ = zip(*((r[2], np.frombuffer(r[3], np.uint64)) for r in part), strict=True)
            yield from _links(np.array(names), list(sets_), percent)

    parts = sets.select("cluster", "part", "class", "shingles").repartition("cluster", "part")
    return map_rows(parts.sortWithinPartitions("cluster", "part"), run, "a bigint, b bigint")


def _parted(sets: DataFrame, percent: int, block_bytes: int, block_sets: int) -> tuple[DataFrame, DataFrame]:
    """Large clusters as pairs of blocks, and the links to their leaders.

    A cluster's leader is the class that shares most bands. Classes linked to it are connected already, so that blocks of
    them need comparing only with the others.
    """
    best = F.struct("shared", "class")
    leaders = sets.groupBy("cluster").agg(F.max_by("shingles", best).alias("lead"), F.max_by("class", best).alias("leader"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for name, cluster, shingles, lead, leader in rows:
            own, other = np.frombuffer(shingles, np.uint64), np.frombuffer(lead, np.uint64)
            common = len(np.intersect1d(own, other, assume_unique=True))
            near = 100 * common >= percent * (len(own) + len(other) - common)
            yield name, cluster, shingles, leader, bool(near)

    joined = lookup_join(sets, cut(leaders, "minhash-leaders"), "cluster")
    judged = map_rows(
        joined.select("class", "cluster", "shingles", "lead", "leader"), run,
        "class bigint, cluster bigint, shingles binary, leader bigint, near boolean",
    )
    judged = cut(judged, "minhash-judged")
    size = F.octet_length("shingles").cast("bigint")
    width = lambda on: F.greatest(
        F.ceil(F.sum(F.when(on, size)) / block_bytes), F.ceil(F.count(F.when(on, 1)) / block_sets), F.lit(1)
    ).cast("bigint")
    n_blocks = judged.groupBy("cluster").agg(width(F.col("near")).alias("n_near"), width(~F.col("near")).alias("n_far"))
    dealt = lookup_join(judged, cut(n_blocks, "minhash-blocks"), "cluster")
    # Blocks 0 .. n_far - 1 are of the others, the next n_near of the leader's.
    far = F.pmod(F.xxhash64("class"), F.col("n_far"))
    block = F.when(F.col("near"), F.col("n_far") + F.pmod(F.xxhash64("class"), F.col("n_near"))).otherwise(far)
    last = F.when(F.col("near"), F.col("n_far")).otherwise(F.col("n_far") + F.col("n_near")) - 1
    paired = dealt.withColumn("block", block).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    part = F.concat_ws("-", F.least("block", "partner"), F.greatest("block", "partner"))
    links = judged.where("near AND class != leader").select(F.col("class").alias("a"), F.col("leader").alias("b"))
    return paired.select("cluster", part.alias("part"), "class", "shingles"), links


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block_bytes: int = BLOCK_BYTES,
    block_sets: int = BLOCK_SETS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Components of the documents that links connect; one row per document.

    Words are runs without ASCII white space, A-Z as a-z. A document's set holds its different five-word shingles, or all
    its words as one if there are fewer. Documents are linked if their sets have at least `percent` of a hundred in common.

    Columns: doc_id, row_key (hash of doc_id and text), n_shingles, component_id (smallest doc_id that links reach, its
    own included), kept (doc_id is component_id).

    A text that is null, empty or without words has no shingles, no links and is kept. Null ids count as larger than all
    others; a component of null ids has a null component_id and its rows are kept. Repeated rows are linked by their equal
    sets, and as they share a doc_id they are kept or dropped together. Empty tables give no rows. Other columns are not
    read.
    """
    signed = cut(signatures(docs, bands, rows, doc_id, text), "minhash-signatures")
    classes = signed.where("n_shingles > 0").groupBy("class", "bands").agg(
        F.min("doc_id").alias("low"), F.min("row_key").alias("row_key"), F.count("*").alias("copies")
    )
    classes = cut(classes, "minhash-classes")
    posted = classes.select("class", F.explode("bands").alias("key"))
    met = posted.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    # A large group of near copies has one key per band: its rows are spread over salts.
    met = lookup_join(posted, cut(met.select("key", "least"), "minhash-keys"), "key")
    met = cut(met.select(F.col("class").alias("a"), F.col("least").alias("b")), "minhash-met")
    clusters = connected_components(met).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    shared = met.groupBy(F.col("a").alias("class")).agg(F.count("*").alias("shared"))
    members = cut(clusters.join(shared, "class").join(classes.select("class", "row_key"), "class"), "minhash-members")

    sets = cut(_sets(docs, members, doc_id, text), "minhash-sets")
    weights = sets.groupBy("cluster").agg(
        F.sum(F.octet_length("shingles").cast("bigint")).alias("_bytes"), F.count("*").alias("_sets")
    )
    large = cut(weights.where((F.col("_bytes") > block_bytes) | (F.col("_sets") > block_sets)).select("cluster"), "minhash-large")
    whole = lookup_join(sets, large, "cluster", "left_anti").withColumn("part", F.lit("0-0"))
    paired, links = _parted(lookup_join(sets, large, "cluster", "left_semi"), percent, block_bytes, block_sets)
    found = _compare(whole.select(*paired.columns).unionByName(paired), percent).unionByName(links)

    roots = connected_components(cut(found, "minhash-links")).withColumnRenamed("node", "class")
    grouped = classes.select("class", "low", "copies").join(roots, "class", "left")
    grouped = grouped.where("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "class"))
    grouped = cut(grouped.select("class", "low", "root"), "minhash-grouped")
    lowest = cut(grouped.groupBy("root").agg(F.min("low").alias("component")), "minhash-lowest")
    named = cut(lookup_join(grouped.select("class", "root"), lowest, "root").drop("root"), "minhash-named")
    joined = lookup_join(signed.drop("bands"), named, "class", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
