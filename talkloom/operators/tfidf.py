"""TF-IDF as a long table `(doc_id, term, tf, w)`: raw counts, smoothed idf plus one, rows of unit length.

An idf table that can be sent to every task is joined where the documents lie; a larger one is fetched by blocks of
documents (`token_blocks`). So whatever the vocabulary, documents are shuffled and their terms are not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import explode_tokens
from talkloom.operators.reduce import project_signs, random_projection
from talkloom.operators.token_blocks import coded, deal, fetch
from talkloom.runtime import BROADCAST_ROWS, cut, dense_index, fits_broadcast, lookup_join

# Fixed value: a word of the default vectoriser, two or more word characters.
WORD = r"(?U)\b\w\w+\b"


@dataclass
class Tfidf:
    """Weights, idf per term and the number of documents, documents without terms included."""

    weights: DataFrame
    idf: DataFrame
    n_docs: int


def raw_words(column: Column | str) -> Column:
    """Words of uncleaned text."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), 0)


def term_counts(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Term frequencies. Token lists are spread by key before they are exploded, so the counts here and the row
    norms later share that one shuffle."""
    spread = docs.select(F.col(key).alias("doc_id"), F.col(tokens).alias("_tokens")).repartition("doc_id")
    return (
        explode_tokens(spread, "_tokens", keep=("doc_id",), name="term")
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def idf_table(
    docs: DataFrame, n_docs: int, tokens: str = "tokens", vocabulary: DataFrame | None = None
) -> DataFrame:
    """`(term, df, idf)`. Repeated terms are dropped inside each list, so only per-task counts are shuffled."""
    df = explode_tokens(docs, F.array_distinct(tokens), name="term").groupBy("term").agg(F.count("*").alias("df"))
    if vocabulary is not None:
        df = df.join(vocabulary.select("term"), "term", "left_semi")
    return df.withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1)


def tfidf(
    docs: DataFrame, tokens: str = "tokens", key: str = "doc_id", vocabulary: DataFrame | None = None
) -> Tfidf:
    """Fit and transform. Terms outside a given vocabulary are ignored.

    Token lists are shuffled once, by document, if the idf table (one row per term, cut) may be broadcast by its checked
    size, and by blocks of documents otherwise.
    """
    n_docs = docs.count()
    idf = cut(idf_table(docs, n_docs, tokens, vocabulary), "idf")
    if not fits_broadcast(idf.select("term", "idf")):
        return Tfidf(_weights_by_blocks(docs, idf, tokens, key), idf, n_docs)
    return Tfidf(_weights_by_lookup(docs, idf, tokens, key), idf, n_docs)


def _weights_by_lookup(docs: DataFrame, idf: DataFrame, tokens: str, key: str) -> DataFrame:
    counts = term_counts(docs, tokens, key)
    weighted = counts.join(F.broadcast(idf.select("term", "idf")), "term").select(
        "doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("_x")
    )
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy("doc_id")))
    return weighted.select("doc_id", "term", "tf", (F.col("_x") / norm).alias("w"))


def _weights_by_blocks(docs: DataFrame, idf: DataFrame, tokens: str, key: str) -> DataFrame:
    """Weights with an idf table of any size; the counts of rows of one key are added up."""
    kind = docs.schema[key].dataType.simpleString()
    total = idf.agg(F.sum("df")).first()[0] or 0
    blocks = deal(docs, tokens, F.xxhash64(key), [F.col(key).alias("doc_id")], total)

    def weigh(_, table, known):
        import pyarrow as pa

        ids, owner, terms, code, tf, w = _weighed(table, known)
        return pa.table({
            "doc_id": ids.dictionary.take(pa.array(owner)), "term": terms.take(pa.array(code)),
            "tf": pa.array(tf, pa.int64()), "w": w,
        })

    known = fetch(blocks, idf.select("term", "idf"), "term")
    return blocks.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(
        weigh, f"doc_id {kind}, term string, tf bigint, w double"
    )


def _weighed(table, known) -> tuple:
    """Of a block and the idf of its terms: the rows' keys, dictionary-encoded, the terms, and key, term, count and weight of each
    cell, a key's cells together."""
    import pyarrow.compute as pc

    row, code, terms = coded(table)
    ids = table["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    owner = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    place = pc.index_in(terms, known["term"].combine_chunks()).fill_null(len(known))
    value = np.append(known["idf"].to_numpy(), np.nan)[place.to_numpy(zero_copy_only=False)]
    pairs, tf = np.unique((owner * len(terms) + code)[~np.isnan(value)[code]], return_counts=True)
    owner, code = np.divmod(pairs, max(len(terms), 1))
    x = tf * value[code]
    norm = np.sqrt(np.bincount(owner, x * x, len(ids.dictionary)))
    return ids, owner, terms, code, tf, x / norm[owner]


def tfidf_projection(docs: DataFrame, dim: int, seed: int = 42, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """`(doc_id, vec)`: `random_projection` of the weights to unit length, for each row of `docs`; zeros where it has no terms
    or no key. Blocks of documents project their own weights, which are neither stored nor shuffled."""
    n_docs = docs.count()
    idf = cut(idf_table(docs, n_docs, tokens), "idf")
    kind = docs.schema[key].dataType.simpleString()
    if fits_broadcast(idf.select("term", "idf")):
        projected = random_projection(_weights_by_lookup(docs, idf, tokens, key), dim, seed, unit=True)
        projected = projected.withColumn("vec", F.col("vec").cast("array<float>"))
        zero = F.array_repeat(F.lit(0.0), dim).cast("array<float>")
        rows = docs.select(F.col(key).alias("doc_id")).join(projected, "doc_id", "left")
        return rows.withColumn("vec", F.coalesce("vec", zero))
    # A row's vector takes as much as some dozens of tokens, so that rows of few words don't make a block large.
    total = (idf.agg(F.sum("df")).first()[0] or 0) + n_docs * -(-dim // 8)
    blocks = deal(docs, tokens, F.xxhash64(key), [F.col(key).alias("doc_id")], total)

    def project(_, table, known):
        import pyarrow as pa

        ids, owner, terms, code, _, w = _weighed(table, known)
        # The hash of `random_projection`: Spark's xxhash64 is that of the bytes, with this seed.
        hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in terms.to_pylist()], np.uint64).view(np.int64)
        vectors = project_signs(hashes[code], w, owner, len(ids.dictionary), dim, seed, True).astype(np.float32)
        named = ids.dictionary.is_valid().to_numpy(zero_copy_only=False)
        flat = (vectors * named[:, None].astype(np.float32))[ids.indices.to_numpy(zero_copy_only=False)]
        ends = pa.array(np.arange(len(flat) + 1) * dim, pa.int32())
        return pa.table({"doc_id": table["doc_id"], "vec": pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))})

    known = fetch(blocks, idf.select("term", "idf"), "term").groupBy("_block")
    return blocks.groupBy("_block").cogroup(known).applyInArrow(project, f"doc_id {kind}, vec array<float>")


def tfidf_raw_text(docs: DataFrame, text: str, key: str = "doc_id", vocabulary: DataFrame | None = None) -> Tfidf:
    words = docs.select(F.col(key).alias("doc_id"), raw_words(text).alias("tokens"))
    return tfidf(words, vocabulary=vocabulary)


def sparse_vectors(docs: DataFrame, n_terms: int, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Rows as unit-length ML sparse vectors `(doc_id, features)`, computed row by row in the JVM.

    The vocabulary travels to every executor with the model, so its size is checked. Past the limit, cluster or
    reduce the long table instead (`sparse_kmeans`, `truncated_svd_terms`). ML's idf lacks the plus one, which the scaling adds.
    """
    if n_terms > BROADCAST_ROWS:
        raise ValueError(f"{n_terms} terms: use sparse_vectors_by_blocks, or sparse_kmeans or truncated_svd_terms on the long table")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(tokens).alias("_tokens"))
    counter = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=n_terms, minDF=1).fit(rows)
    counted = counter.transform(rows)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_x")
    unit = Normalizer(p=2.0, inputCol="_x", outputCol="features")
    return unit.transform(scale.transform(counted)).select("doc_id", "features")


def sparse_vectors_by_blocks(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """The vectors of `sparse_vectors` for a vocabulary of any size, which no task holds. Places are the alphabetical order."""
    idf = idf_table(docs, docs.count(), tokens)
    total, n_terms = idf.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count("*")).first()
    numbered = cut(dense_index(idf.select("term", "idf"), "term"), "idf")
    blocks = deal(docs, tokens, F.xxhash64(key, tokens), [F.col(key).alias("doc_id")], total)

    def vectors(_, table, known):
        import pyarrow as pa
        import pyarrow.compute as pc

        row, code, terms = coded(table)
        place = pc.index_in(terms, known["term"].combine_chunks()).to_numpy(zero_copy_only=False)
        cells, tf = np.unique(row * n_terms + known["idx"].to_numpy()[place][code], return_counts=True)
        own, value = np.zeros(0, np.int64), np.zeros(0)
        if len(cells):
            own, index = np.divmod(cells, n_terms)
            order = np.argsort(known["idx"].to_numpy())
            at = order[np.searchsorted(known["idx"].to_numpy()[order], index)]
            value = tf * known["idf"].to_numpy()[at]
            value /= np.sqrt(np.bincount(own, value * value, len(table)))[own]
            cells = index
        ends = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=len(table)))), pa.int32())
        return pa.table({
            "doc_id": table["doc_id"], "indices": pa.ListArray.from_arrays(ends, pa.array(cells, pa.int32())),
            "values": pa.ListArray.from_arrays(ends, pa.array(value, pa.float64())),
        })

    kind = docs.schema[key].dataType.simpleString()
    known = fetch(blocks, numbered, "term").groupBy("_block")
    found = blocks.groupBy("_block").cogroup(known).applyInArrow(
        vectors, f"doc_id {kind}, indices array<int>, values array<double>"
    )
    # ML has no column expression that makes a sparse vector.
    vector = F.udf(lambda i, v: SparseVector(n_terms, i, v), VectorUDT())
    return found.select("doc_id", vector("indices", "values").alias("features"))


def corpus_mean(weights: DataFrame, n_docs: int) -> DataFrame:
    """Column means over all documents, zeros counted."""
    return weights.groupBy("term").agg((F.sum("w") / F.lit(n_docs)).alias("mean_w"))


def top_words(weights: DataFrame, n_docs: int, n: int = 20, digits: int = 6) -> DataFrame:
    """Terms with the highest mean weight; ties by term, on the rounded score."""
    means = corpus_mean(weights, n_docs).withColumn("mean_w", F.round("mean_w", digits))
    return means.orderBy(F.desc("mean_w"), "term").limit(n)
